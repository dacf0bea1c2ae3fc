"""The vector cache against the rules of when to append and when to build anew."""

import json

from larkspur.operators.vector_cache import VectorCache

DDL = "source string, msg_id long, model string, embedding string, created_at string, extra int"


def row(i, vec, at, model="m"):
    return ("app", i, model, vec if isinstance(vec, str) or vec is None else json.dumps(vec), at, 0)


def test_refreshes(spark, tmp_path):
    cache = VectorCache(spark, f"file://{tmp_path}/cache")
    store = lambda *rows: spark.createDataFrame(list(rows), DDL)
    held = lambda: {r.msg_id: list(r.vec) for r in cache.vectors().collect()}
    bad = lambda done: {r.msg_id: r.why for r in done.bad.collect()}
    assert cache.vectors() is None
    first = [row(1, [1.0, 0.0], "2026-01-01"), row(2, [0.0, 1.0], "2026-01-02"), row(3, [1.0], "2026-01-02"), row(4, "no", "2026-01-02"), row(5, [9.0, 9.0], "2026-01-02", "n")]
    done = cache.refresh(store(*first), "m")
    assert (done.kind, done.dimension, bad(done)) == ("rebuild", 2, {3: "dimension", 4: "no vector"})
    assert held() == {1: [1.0, 0.0], 2: [0.0, 1.0]}
    # What is as new as the last refresh comes again; a key's newest vector holds; others of another dimension stay out.
    second = [*first[:1], row(2, [0.5, 0.5], "2026-01-02"), *first[2:], row(6, [3.0, 4.0], "2026-01-03"), row(7, [1.0, 2.0, 3.0], "2026-01-03")]
    done = cache.refresh(store(*second), "m")
    assert (done.kind, done.dimension) == ("append", 2) and bad(done) == {3: "dimension", 4: "no vector", 7: "dimension"}
    assert held() == {1: [1.0, 0.0], 2: [0.5, 0.5], 6: [3.0, 4.0]}
    # A removed row has no time to find it by: fewer rows, built anew.
    done = cache.refresh(store(*second[1:]), "m")
    assert done.kind == "rebuild" and held() == {2: [0.5, 0.5], 6: [3.0, 4.0]}
    # All new vectors agree on another dimension: those of before with it come in, the rest is bad.
    third = [*second[1:4], row(7, [1.0, 2.0, 3.0], "2026-01-03"), *[row(i, [1.0, 1.0, float(i)], "2026-01-04") for i in range(8, 14)]]
    third += [row(6, [3.0, 4.0, 5.0], "2026-01-04")]
    done = cache.refresh(store(*third), "m")
    assert (done.kind, done.dimension) == ("rebuild", 3) and bad(done) == {2: "dimension", 3: "dimension", 4: "no vector"}
    assert sorted(held()) == [6, 7, 8, 9, 10, 11, 12, 13]
    # Another model; a forced one; an emptied store.
    done = cache.refresh(store(*third, *[row(i, [1.0], "2026-01-01", "n") for i in range(20, 22)]), "n")
    assert (done.kind, done.dimension, sorted(held())) == ("rebuild", 1, [20, 21])
    assert cache.refresh(store(*third, *[row(i, [1.0], "2026-01-01", "n") for i in range(21, 23)]), "n", force=True).kind == "rebuild" and sorted(held()) == [21, 22]
    assert cache.refresh(store(), "n").kind == "rebuild" and held() == {}
    assert cache.refresh(store(row(30, [2.0], "2026-02-01", "n")), "n").kind == "append" and held() == {30: [2.0]}


def test_a_refresh_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    cache = VectorCache(spark, f"file://{tmp_path}/cache")
    cache.refresh(spark.createDataFrame([row(1, [1.0], "a")], DDL), "m")
    with monkeypatch.context() as m:
        m.setattr(cache.manifests, "add", lambda table: (_ for _ in ()).throw(OSError("lost")))
        try:
            cache.refresh(spark.createDataFrame([row(1, [1.0], "a"), row(2, [2.0], "b")], DDL), "m")
        except OSError:
            pass
    assert [r.msg_id for r in cache.vectors().collect()] == [1]
    cache.refresh(spark.createDataFrame([row(1, [1.0], "a"), row(2, [2.0], "b")], DDL), "m")
    assert sorted(r.msg_id for r in cache.vectors().collect()) == [1, 2]
