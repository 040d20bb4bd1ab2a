from auditlake.llm import components as stars
from auditlake.llm import shared


def rounds(spark, monkeypatch, edges):
    seen = []
    monkeypatch.setattr(stars, "written", lambda rows, name: seen.append(name) or shared.written(rows, name))
    got = {r.node: r.component for r in stars.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    return got, len(seen) - 1


def test_stars_take_one_round_and_no_edges_none(spark, monkeypatch):
    assert rounds(spark, monkeypatch, [(k, 10 * (k // 10)) for k in range(100)]) == ({k: 10 * (k // 10) for k in range(100)}, 1)
    assert rounds(spark, monkeypatch, []) == ({}, 0)
    # Loops alone are no edges.
    assert rounds(spark, monkeypatch, [(3, 3)]) == ({}, 0)
    got, n = rounds(spark, monkeypatch, [(k, k + 1) for k in range(40)])
    assert got == dict.fromkeys(range(41), 0) and n > 1


def collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_a_grown_heap_is_collected_between_writes(spark, monkeypatch):
    rows = spark.range(3)
    monkeypatch.setattr(shared, "HEAP_SHARE", 1.0)
    before = collections(spark)
    shared.written(rows, "rows")
    calm = collections(spark)
    monkeypatch.setattr(shared, "HEAP_SHARE", 0.0)
    assert sorted(r.id for r in shared.written(rows, "rows").collect()) == [0, 1, 2]
    assert calm == before and collections(spark) > calm
