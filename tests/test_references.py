import random
from datetime import datetime as D

import pytest

from sagebrook.operators import references as R
from sagebrook.operators.references import OrphanLedger, Reference, references


def refs(spark, rows):
    return spark.createDataFrame(rows, "tab string, field string, rec_id long, ref_id long, target string, at timestamp_ntz")


def at(spark, rows):
    return spark.createDataFrame(rows, "target string, key long, at timestamp_ntz")


def kinds(ledger):
    return {(r.rec_id, r.ref_id): (r.kind, r.period) for r in ledger.orphans().collect()}


def test_states(spark):
    ledger = OrphanLedger(spark)
    ledger.ingest(refs(spark, [("e", "f", 1, 10, "t", D(2024, 1, 5)), ("e", "f", 1, 10, "t", D(2024, 1, 5)), ("e", "f", 2, 11, "t", D(2024, 2, 5)), ("e", "f", 3, None, "t", D(2024, 1, 1))]))
    assert kinds(ledger) == {(1, 10): ("missing", "2024-01"), (2, 11): ("missing", "2024-02")}
    ledger.ingest(arrivals=at(spark, [("t", 10, D(2024, 3, 1)), ("t", 11, D(2024, 1, 1)), ("u", 10, D(2020, 1, 1)), ("t", None, D(2020, 1, 1))]))
    assert kinds(ledger) == {(1, 10): ("late", "2024-01")}
    ledger.ingest(deletions=at(spark, [("t", 11, D(2024, 6, 1)), ("t", 11, D(2024, 6, 1))]))
    assert kinds(ledger)[(2, 11)] == ("deleted", "2024-02")
    ledger.ingest(arrivals=at(spark, [("t", 11, D(2024, 7, 1))]))
    assert kinds(ledger)[(2, 11)] == ("late", "2024-02")
    assert {tuple(r) for r in ledger.snapshot().collect()} == {("e", "f", "late", "2024-01", 1), ("e", "f", "late", "2024-02", 1)}
    ledger.close()


def test_old_deletions_and_nulls(spark):
    ledger = OrphanLedger(spark).ingest(
        refs(spark, [("e", "f", 1, 10, "t", None), ("e", "f", 2, 12, "t", D(2024, 5, 1))]),
        at(spark, [("t", 10, D(2024, 3, 1)), ("t", 12, None)]),
        at(spark, [("t", 10, D(2023, 1, 1))]),
    )
    assert kinds(ledger) == {}


def test_any_order_gives_one_state(spark):
    a = refs(spark, [("e", "f", n, n % 7, "t", D(2024, 1, 1 + n)) for n in range(20)])
    b = at(spark, [("t", n, D(2024, 1, 10)) for n in range(5)])
    c = at(spark, [("t", n, D(2024, 2, 1)) for n in (1, 6)])
    states = []
    for order in ([("r", a), ("p", b), ("d", c)], [("d", c), ("p", b), ("r", a)], [("p", b), ("r", a), ("d", c)]):
        ledger = OrphanLedger(spark)
        for kind, df in order:
            ledger.ingest(**{{"r": "refs", "p": "arrivals", "d": "deletions"}[kind]: df})
        states.append(kinds(ledger))
    assert states[0] == states[1] == states[2] and len(states[0]) > 8


def test_hot_key(spark, monkeypatch):
    monkeypatch.setattr(R, "SALTS", 4)
    rows = spark.range(3000).selectExpr("'e' tab", "'f' field", "id rec_id", "CASE WHEN id % 3 = 0 THEN 1 ELSE id + 10 END ref_id", "'t' target", "TIMESTAMP_NTZ'2024-01-01 00:00:00' at")
    parents = spark.range(3000).selectExpr("'t' target", "id + 10 key", "TIMESTAMP_NTZ'2023-01-01 00:00:00' at")
    found = OrphanLedger(spark).ingest(rows, parents).orphans()
    assert found.count() == 1000 and found.where("ref_id = 1 AND kind = 'missing'").count() == 1000


def test_references(spark):
    df = spark.createDataFrame([(1, [5, 5, None], 7, D(2024, 1, 1), "x"), (2, None, None, D(2024, 1, 1), "y"), (3, [], 8, None, "z")], "id long, many array<long>, one long, inserted_at timestamp_ntz, target string")
    out = references({"t": df}, [Reference("t", "many", "p"), Reference("t", "one", "p")])
    assert sorted((r.rec_id, r.field, r.ref_id) for r in out.collect()) == [(1, "many", 5), (1, "one", 7), (3, "one", 8)]


@pytest.mark.parametrize("batch", [{}, {"refs": True}, {"arrivals": True}, {"deletions": True}])
def test_empty(spark, batch):
    empty = {"refs": refs(spark, []), "arrivals": at(spark, []), "deletions": at(spark, [])}
    ledger = OrphanLedger(spark).ingest(**{k: empty[k] for k in batch})
    assert ledger.orphans().count() == 0 and ledger.snapshot().count() == 0


def test_repeated_references_in_any_order_and_a_restart(spark):
    """The earliest time of a repeated reference counts whatever the batches, and another process goes on from the folder."""
    rng = random.Random(5)
    rows = [("e", "f", rng.randrange(12), rng.randrange(9), "t", D(2024, rng.randrange(1, 13), 1)) for _ in range(80)]
    born = [("t", rng.randrange(9), D(2024, rng.randrange(1, 13), 2)) for _ in range(12)]
    gone = [("t", rng.randrange(9), D(2024, rng.randrange(1, 13), 3)) for _ in range(6)]
    states = []
    for _ in range(3):
        steps = [("refs", rows[k::3]) for k in range(3)] + [("arrivals", born[k::2]) for k in range(2)] + [("deletions", gone)]
        rng.shuffle(steps)
        ledger = OrphanLedger(spark)
        for n, (kind, part) in enumerate(steps):
            if n == 3:
                ledger = OrphanLedger(spark, ledger.folder)
            ledger.ingest(**{kind: (refs if kind == "refs" else at)(spark, part)})
        states.append(kinds(ledger))
        assert len(ledger.snapshots()) == len(steps) and sum(r.n for r in ledger.snapshot().collect()) == len(states[-1])
        ledger.vacuum()
        assert kinds(OrphanLedger(spark, ledger.folder)) == states[-1]
        ledger.close()
    assert states[0] == states[1] == states[2] and len(states[0]) > 10


def test_only_touched_buckets_are_written_and_two_writers_do_not_mix(spark):
    ledger = OrphanLedger(spark).ingest(refs(spark, [("e", "f", n, n, "t", D(2024, 1, 1)) for n in range(200)]))
    assert len(ledger.current["refs"]) == ledger.buckets
    other = OrphanLedger(spark, ledger.folder)
    ledger.ingest(arrivals=at(spark, [("t", 7, D(2023, 1, 1))]))
    assert sum(v.startswith("v2-") for v in ledger.current["refs"].values()) == 1 and ledger.orphans().count() == 199
    with pytest.raises(RuntimeError):
        other.ingest(arrivals=at(spark, [("t", 8, D(2023, 1, 1))]))
    assert OrphanLedger(spark, ledger.folder).orphans().count() == 199
