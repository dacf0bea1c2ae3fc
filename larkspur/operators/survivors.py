"""Near-duplicate decisions over many runs: the survivors of earlier runs and the verdicts that were negative.

Both stores keep a snapshot a run in the shared folder; a snapshot counts once it is whole (Spark's _SUCCESS file), so a run
that fails leaves the one before in place and is simply done again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import digest, judge_key
from larkspur.operators.dedup import Judge, decide
from larkspur.schemas import Settings
from larkspur.scratch import written

CARD = ["seq", "source", "title", "source_quote", "image_urls", "vec"]


class Snapshots:
    """Numbered whole tables in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def numbers(self) -> list[int]:
        files, target = self._folder()
        if not files.exists(target):
            return []
        names = [f.getPath() for f in files.listStatus(target)]
        done = [p for p in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("run=")) for p in done)

    def newest(self) -> DataFrame | None:
        runs = self.numbers()
        return self.spark.read.parquet(f"{self.path}/run={runs[-1]}") if runs else None

    def add(self, table: DataFrame) -> int:
        number = (self.numbers() or [0])[-1] + 1
        table.write.mode("overwrite").parquet(f"{self.path}/run={number}")
        return number

    def drop_older(self, keep: int = 2) -> None:
        files, _ = self._folder()
        for number in self.numbers()[:-keep]:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/run={number}"), True)


class NegativeVerdicts:
    """Verdicts "not the same" by (query key, candidate, version of the candidate's text). A candidate whose text was rewritten has
    another version, so what was said of the old text is not found any more. At most `most` verdicts stay, those of the
    newest use."""

    def __init__(self, spark: SparkSession, path: str, most: int = 1_000_000):
        self.store, self.most, self.used = Snapshots(spark, path), most, []

    def remember(self, judge: Judge) -> Judge:
        """The judge, asked only about pairs without a stored verdict; what it denies is stored at the next `commit`."""
        known = self.store.newest()

        def ask(pairs: DataFrame) -> DataFrame:
            keys = ["qkey", "item_id", "item_version"]
            keyed = written(pairs.withColumns({"qkey": judge_key(F.col("title"), F.col("quote")), "item_id": F.concat_ws("\x00", "scope", F.col("cand_seq").cast("string")), "item_version": digest(F.concat_ws("\x00", F.coalesce("cand_title", F.lit("")), F.coalesce("cand_quote", F.lit(""))))}), "keyed")
            if known is None:
                told = judge(keyed)
            else:
                stored = known.select(*keys)
                found = keyed.join(stored, keys, "left_semi").withColumn("same", F.lit(False))
                told = judge(keyed.join(stored, keys, "left_anti")).select(*keyed.columns, "same").unionByName(found)
            told = written(told.select(*keyed.columns, "same"), "told")
            self.used.append(told.where("NOT same").select(*keys))
            return told.select(*pairs.columns, "same")

        return ask

    def commit(self) -> None:
        """Write what was denied or used since the last commit, newest first, with what was known before."""
        known, number = self.store.newest(), (self.store.numbers() or [0])[-1] + 1
        rows = known if known is not None else None
        for used in self.used:
            used = used.withColumn("run", F.lit(number))
            rows = used if rows is None else rows.unionByName(used)
        if rows is not None:
            newest = rows.groupBy("qkey", "item_id", "item_version").agg(F.max("run").alias("run"))
            self.store.add(newest.orderBy(F.desc("run"), "qkey", "item_id", "item_version").limit(self.most))
        self.used = []


class SurvivorStore:
    """The cards that later cards are compared with, over any number of runs."""

    def __init__(self, spark: SparkSession, path: str, negatives: NegativeVerdicts | None = None):
        self.store, self.negatives = Snapshots(spark, path), negatives

    def survivors(self) -> DataFrame | None:
        return self.store.newest()

    def run(self, cards: DataFrame, judge: Judge, settings: Settings = Settings(), image_sources: tuple[str, ...] | None = None) -> DataFrame:
        """Decide cards (seq, source, title, source_quote, image_urls, vec) against the survivors so far and keep those that survive.
        Numbers grow from run to run; cards whose number is a survivor already are passed over."""
        earlier = self.survivors()
        cards = written(cards.select(*CARD) if earlier is None else cards.select(*CARD).join(earlier.select("seq"), "seq", "left_anti"), "cards")
        found = decide(cards, self.negatives.remember(judge) if self.negatives else judge, earlier, settings, image_sources)
        kept = cards.join(found.where("duplicate_of IS NULL").select("seq"), "seq", "left_semi").select(*CARD)
        self.store.add(kept if earlier is None else earlier.unionByName(kept))
        if self.negatives:
            self.negatives.commit()
        return found

    def change(self, remove: DataFrame | None = None, rewrite: DataFrame | None = None) -> None:
        """Take cards (seq) out, and put cards (all columns) in place of those of the same number; numbers that are not there are
        added, so a removed card can come back in its old place."""
        now = self.survivors()
        if now is None:
            now = rewrite.select(*CARD).limit(0)
        if remove is not None:
            now = now.join(remove.select("seq"), "seq", "left_anti")
        if rewrite is not None:
            now = now.join(rewrite.select("seq"), "seq", "left_anti").unionByName(rewrite.select(*CARD))
        self.store.add(now)
