"""Document fingerprints: a Merkle tree over the sections, paragraphs and phrases of a text, in Spark functions only.

Leaves are phrases: runs of words that end after punctuation or after a word in e. A paragraph (a line) hashes the
hashes of its phrases, a section (paragraphs up to and including one whose hash says so, or up to a blank line) hashes
its paragraphs, and the root hashes the sections. All boundaries depend on content alone, so an edit changes the
branches that it touches and leaves the others equal: equal roots mean equal texts, and where roots differ the branches
that differ locate the edit.

The fingerprint string is `root/section:paragraph=leaves,paragraph=leaves;section:...`. Nodes are hashed from the whole
SHA-256 hashes of their children up to the root; the labels after the slash are their first 8 digits. Likeness is 1 for
equal roots, else the share of leaves that two trees have in common (twice the shared over the sum of both, distinct leaf
labels).

`edit_first` and `edit_last` locate the edit: the first and last paragraph of the edited text whose branches the tree of
the text does not have at that place, counted from its start and from its end (null where the roots agree).

Defined results: null text counts as empty; the empty text has a tree of one empty leaf; null identifiers come after
all others; rows without an identifier and rows that repeat one are ordered by a hash of their texts; an empty table gives
an empty result. Identifiers are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import free_name

#: A phrase ends at a space after one of these.
PHRASE_END = r"(?<=[eE.,;:!?|%$#*&] )"
#: Hex digits of a node's label below the root.
NODE = 8
#: One paragraph in so many ends a section.
SECTION = 4
#: Rows sorted together to find each document's neighbour.
BUCKET_ROWS = 500
_SPLITS = 64
#: Bucket heads that may be broadcast; beyond it Spark joins them by shuffling.
BROADCAST_HEADS = 500_000


def _label(node: Column) -> Column:
    return F.substring(node, 1, NODE)


def paragraph_nodes(text: Column) -> Column:
    """array<struct<node, leaves, blank>>: a paragraph's whole hash and the joined labels of its phrases."""
    hashed = F.transform(F.split(text, "\n"), lambda p: F.struct(F.transform(F.split(p, PHRASE_END), lambda x: F.sha2(x, 256)).alias("leaves"), (F.trim(p) == "").alias("blank")))
    return F.transform(hashed, lambda x: F.struct(F.sha2(F.concat_ws("", x["leaves"]), 256).alias("node"), F.concat_ws("", F.transform(x["leaves"], _label)).alias("leaves"), x["blank"].alias("blank")))


def section_nodes(paragraphs: Column) -> Column:
    """array<struct<node, branches>>: the whole hash and `paragraph=leaves,...` of each section of the paragraphs."""
    ends_here = lambda p: p["blank"] | (F.conv(F.substring(p["node"], 1, 2), 16, 10).cast("int") % SECTION == 0)
    last = F.size(paragraphs)
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: (i == last) | ends_here(F.element_at(paragraphs, i)))
    begins = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
    spans = F.arrays_zip(begins.alias("begin"), ends.alias("end"))

    def node(span: Column) -> Column:
        own = F.slice(paragraphs, span["begin"] + 1, span["end"] - span["begin"])
        hashes = F.concat_ws("", F.transform(own, lambda p: p["node"]))
        branches = F.concat_ws(",", F.transform(own, lambda p: F.concat(_label(p["node"]), F.lit("="), p["leaves"])))
        return F.struct(F.sha2(hashes, 256).alias("node"), branches.alias("branches"))

    return F.transform(spans, node)


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """df with the fingerprint of a text column expression; each level is a column of its own so that it is made once."""
    p, s = free_name(df, f"{name}_paragraphs"), free_name(df, f"{name}_sections")
    df = df.withColumn(p, paragraph_nodes(F.coalesce(text, F.lit("")))).withColumn(s, section_nodes(F.col(p)))
    root = F.sha2(F.concat_ws("", F.transform(F.col(s), lambda x: x["node"])), 256)
    labels = F.transform(F.col(s), lambda x: F.concat(_label(x["node"]), F.lit(":"), x["branches"]))
    return df.withColumn(name, F.concat(root, F.lit("/"), F.concat_ws(";", labels))).drop(p, s)


def leaf_codes(fingerprint: Column) -> Column:
    """The distinct leaves of a fingerprint string."""
    leaves = F.regexp_replace(fingerprint, "^[^/]*/|[0-9a-f]{8}[:=]|[,;]", "")
    return F.array_distinct(F.regexp_extract_all(leaves, F.lit("[0-9a-f]{8}"), F.lit(0)))


def likeness(a: Column, b: Column, a_leaves: Column, b_leaves: Column) -> Column:
    shared = F.size(F.array_intersect(a_leaves, b_leaves))
    same = F.substring_index(a, "/", 1) == F.substring_index(b, "/", 1)
    return F.when(same, 1.0).otherwise(2.0 * shared / (F.size(a_leaves) + F.size(b_leaves)))


def _order_key(docs: DataFrame, id_col: str, tie: Column) -> Column:
    """A number that orders rows by identifier and, within one identifier, by the bits of a hash that the numbers have room
    for, so that rows without an identifier (below all others) or with a common one spread over a range of numbers."""
    ends = docs.agg(F.min(F.col(id_col).cast("long")).alias("lo"), F.max(F.col(id_col).cast("long")).alias("hi")).first()
    lo, hi = ends["lo"] or 0, ends["hi"] or 0
    bits = min(30, 61 - (hi - lo + 2).bit_length())
    if bits <= 0:  # identifiers all over the range of a long: no room
        return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    own = F.coalesce(F.col(id_col).cast("long") - F.lit(lo - 1), F.lit(0))
    return own * F.lit(1 << bits) + F.shiftrightunsigned(tie, 64 - bits)


def _with_bucket(docs: DataFrame, key: str, bucket: str) -> DataFrame:
    """docs with a bucket number that grows with `key`, of about BUCKET_ROWS rows each.

    Quantiles (at most _SPLITS numbers) give coarse ranges; each is divided evenly.
    """
    stats = docs.agg(F.count("*").alias("n"), F.percentile_approx(key, [i / _SPLITS for i in range(_SPLITS + 1)], 10_000).alias("q"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    edges = sorted({*(stats["q"] or []), stats["lo"], stats["hi"]} - {None}) or [0]
    inner = max(1, round((stats["n"] or 0) / max(1, len(edges) - 1) / BUCKET_ROWS))
    # A sum of comparisons, not a lambda: the key is then evaluated once a row.
    at = F.greatest(F.lit(0), sum(((F.col(key) >= x).cast("int") for x in edges[:-1]), F.lit(0)) - 1)
    lo, hi = F.array(*[F.lit(float(x)) for x in edges]), F.array(*[F.lit(float(x)) for x in [*edges[1:], edges[-1] + 1]])
    low, high = F.element_at(lo, at + 1), F.element_at(hi, at + 1)
    fine = F.greatest(F.lit(0), F.least(F.lit(inner - 1), F.floor((F.col(key).cast("double") - low) / F.greatest(F.lit(1.0), high - low) * inner)))
    return docs.withColumn(bucket, (at * inner + fine).cast("long"))


def with_next_document(docs: DataFrame, id_col: str, carried: list[str]) -> DataFrame:
    """docs with `next_<c>` for each carried column: its value in the next document by descending identifier, and in the
    document with the highest identifier after the last. Rows of one identifier go by a hash of the first carried column.

    A row goes to the bucket of its identifier; the first row of each bucket also goes, as a copy, to the end of the
    bucket before. Texts are shuffled once and no window spans more than a bucket.
    """
    key, bucket, copy, tie, to, place = (free_name(docs, n) for n in ("key_", "bucket_", "copy_", "tie_", "to_", "place_"))
    tied = docs.withColumn(tie, F.xxhash64(carried[0]))
    keyed = _with_bucket(tied.withColumn(key, _order_key(docs, id_col, F.col(tie))), key, bucket)
    # The first row of a bucket; of rows equal in number the one that the window puts first.
    heads = keyed.groupBy(bucket).agg(F.max(F.struct(F.col(key).alias("key"), (-F.col(tie)).alias("tie"))).alias("head"))
    group = heads.withColumn("group", F.floor(F.col(bucket) / 4096))
    group = group.withColumn("to", F.lead(bucket).over(Window.partitionBy("group").orderBy(F.col(bucket).asc())))
    # A row per 4,096 buckets: the first bucket of the next group, and of the whole table after the last.
    firsts = group.groupBy("group").agg(F.min(bucket).alias("low"))
    firsts = firsts.withColumn("over", F.coalesce(F.lead("low").over(Window.orderBy("group")), F.min("low").over(Window.partitionBy())))
    heads = group.join(firsts, "group").select(F.col("head.key").alias(f"{key}k"), (-F.col("head.tie")).alias(f"{tie}k"), F.coalesce("to", "over").alias(to))
    if docs.select(id_col).count() // BUCKET_ROWS + _SPLITS < BROADCAST_HEADS:
        heads = F.broadcast(heads)
    rows = keyed.join(heads, (F.col(key) == F.col(f"{key}k")) & (F.col(tie) == F.col(f"{tie}k")), "left")
    own = F.struct(F.col(bucket).alias("b"), F.lit(False).alias("c"))
    places = F.when(F.col(to).isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col(to).alias("b"), F.lit(True).alias("c"))))
    rows = rows.withColumn(place, F.explode(places)).withColumn(bucket, F.col(place)["b"]).withColumn(copy, F.col(place)["c"])
    order = Window.partitionBy(bucket).orderBy(F.col(copy), F.col(key).desc(), F.col(tie))
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return rows.where(~F.col(copy)).drop(key, bucket, copy, tie, to, place, f"{key}k", f"{tie}k")


def edited_text(text: Column, following: Column) -> Column:
    """The text with its last half replaced by as much of the start of the following text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def paragraph_labels(fingerprint: Column) -> Column:
    """The labels of a fingerprint's paragraphs with their leaves, in the order of the text."""
    return F.regexp_extract_all(fingerprint, F.lit("([0-9a-f]{8}=[0-9a-f]*)"), F.lit(1))


def located_edit(before: Column, after: Column) -> tuple[Column, Column]:
    """(first, last) paragraph of the second fingerprint, from 1, whose branch differs; null where none does."""
    a, b = paragraph_labels(before), paragraph_labels(after)
    front = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    back = F.array_position(F.zip_with(F.reverse(a), F.reverse(b), lambda x, y: x.eqNullSafe(y)), False)
    first, last = F.least(front, F.size(b)), F.size(b) - back + 1
    differ = F.substring_index(before, "/", 1) != F.substring_index(after, "/", 1)
    # Where paragraphs were taken out or repeated, the two sides can pass each other: the seam is the place.
    return F.when(differ, first.cast("long")), F.when(differ, F.greatest(first, last).cast("long"))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edit_first, edit_last for each
    row of docs."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    paired = with_next_document(with_fingerprint(texts, F.col("text"), "fingerprint"), "doc_id", ["text", "fingerprint"])
    edited = paired.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    both = with_fingerprint(edited, F.col("edited"), "edited_fingerprint")
    both = both.withColumns({f"{c}_leaves": leaf_codes(F.col(c)) for c in ("fingerprint", "edited_fingerprint", "next_fingerprint")})
    near = lambda other: likeness(F.col("fingerprint"), F.col(other), F.col("fingerprint_leaves"), F.col(f"{other}_leaves"))
    edit_first, edit_last = located_edit(F.col("fingerprint"), F.col("edited_fingerprint"))
    return both.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        near("edited_fingerprint").alias("near_edited"),
        near("next_fingerprint").alias("near_next"),
        edit_first.alias("edit_first"),
        edit_last.alias("edit_last"),
    )
