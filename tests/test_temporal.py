import random
from datetime import timedelta

import pytest

from fixtures import D, LABEL, US, label, utc
from knownthen.operators.temporal import Basis, rectangles, replayed_timeline, snapshot, timeline, versions


def logs(spark, rows):
    return spark.createDataFrame(rows, LABEL)


def boxes(df):
    return sorted(((r.id, r.is_fraud, *map(utc, (r.valid_from, r.valid_to, r.system_from, r.system_to)))
                   for r in df.collect()), key=str)


def brute(rows):
    """Cell-by-cell winner over the grid of all edges, then merged into maximal boxes."""
    out = []
    for fid in sorted({r[0] for r in rows}):
        facts = sorted([r for r in rows if r[0] == fid and (r[3] is None or r[2] < r[3])], key=lambda r: (r[4], r[5]))
        far = D(100_000)
        edges = sorted({e for r in facts for e in (r[2], r[3] or far)})
        commits = sorted({r[4] for r in facts}) + [far]
        runs = {}
        for lo, hi in zip(edges, edges[1:]):
            spans = {}
            for s, s_next in zip(commits, commits[1:]):
                won = [i for i, r in enumerate(facts) if r[4] <= s and r[2] <= lo and hi <= (r[3] or far)]
                if won:
                    begin, _ = spans.get(won[-1], (s, None))
                    spans[won[-1]] = (begin, s_next)
            for i, (s0, s1) in spans.items():
                runs.setdefault(i, []).append([lo, hi, s0, s1])
        for i, parts in runs.items():
            merged = []
            for p in parts:
                if merged and merged[-1][1] == p[0] and merged[-1][2:] == p[2:]:
                    merged[-1][1] = p[1]
                else:
                    merged.append(list(p))
            if facts[i][6] == "put":
                out += [(fid, facts[i][1], m[0], None if m[1] == far else m[1], m[2], None if m[3] == far else m[3])
                        for m in merged]
    return sorted(out, key=str)


def test_late_import_and_bounded_correction(spark):
    rows = [label("fraud", False, D(1)), label("fraud", True, D(40), D(10)), label("fraud", False, D(50), D(10), D(15))]
    got = sorted(boxes(rectangles(logs(spark, rows))), key=str)
    assert got == sorted([
        ("fraud", False, D(1), D(10), D(1), None),
        ("fraud", False, D(10), None, D(1), D(40)),
        ("fraud", True, D(10), D(15), D(40), D(50)),
        ("fraud", True, D(15), None, D(40), None),
        ("fraud", False, D(10), D(15), D(50), None),
    ], key=str)


def test_imported_timeline_in_one_commit(spark):
    rows = [label("f", False, D(100), D(1), D(10), 0), label("f", True, D(100), D(10), D(20), 1),
            label("f", False, D(100), D(20), D(30), 2), label("f", True, D(100), D(30), None, 3)]
    got = {(r.is_fraud, utc(r.valid_from), utc(r.valid_to)) for r in timeline(logs(spark, rows), Basis()).collect()}
    assert got == {(False, D(1), D(10)), (True, D(10), D(20)), (False, D(20), D(30)), (True, D(30), None)}
    assert timeline(logs(spark, rows), Basis(system_at=D(99))).count() == 0


def test_same_commit_last_seq_wins_without_empty_boxes(spark):
    rows = [label("x", False, D(1), seq=0), label("x", True, D(1), seq=1)]
    assert boxes(rectangles(logs(spark, rows))) == [("x", True, D(1), None, D(1), None)]
    assert snapshot(logs(spark, rows), Basis()).first().is_fraud is True
    assert [r.is_fraud for r in versions(logs(spark, rows), Basis()).collect()] == [True]


def test_delete_then_put_again(spark):
    rows = [label("x", False, D(1)), label("x", None, D(5), op="del"), label("x", True, D(9))]
    log = logs(spark, rows)
    assert snapshot(log, Basis()).first().is_fraud is True
    assert snapshot(log, Basis(system_at=D(6))).count() == 0
    assert snapshot(log, Basis(system_at=D(4))).first().is_fraud is False
    assert snapshot(log, Basis(valid_at=D(6))).count() == 0
    assert snapshot(log, Basis(valid_at=D(3))).first().is_fraud is False
    assert sorted(boxes(rectangles(log)), key=str) == brute(rows)


def test_one_microsecond_before_a_commit(spark):
    log = logs(spark, [label("x", False, D(1)), label("x", True, D(30) + US)])
    assert snapshot(log, Basis(system_at=D(30))).first().is_fraud is False
    assert snapshot(log, Basis(system_at=D(30) + US)).first().is_fraud is True


@pytest.mark.parametrize("seed", [1, 2])
def test_random_histories_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        for n in range(rng.randint(1, 14)):
            lo = rng.randint(0, 20)
            hi = None if rng.random() < 0.5 else lo + rng.randint(1, 12)
            op = "del" if rng.random() < 0.15 else "put"
            rows.append(label(f"x{i}", None if op == "del" else rng.random() < 0.5, D(rng.randint(0, 15)), D(lo),
                              None if hi is None else D(hi), n, op))
    expected = brute(rows)
    # panes of one day and panes wider than everything must agree
    for pane in (timedelta(days=1), timedelta(days=4000)):
        assert sorted(boxes(rectangles(logs(spark, rows), pane)), key=str) == expected
    for s in (D(3), D(9), None):
        cut = [b for b in expected if (s is None and b[5] is None) or
               (s is not None and b[4] <= s and (b[5] is None or s < b[5]))]
        got = timeline(logs(spark, rows), Basis(system_at=s))
        seen = sorted((r.id, r.is_fraud, utc(r.valid_from), r.valid_to and utc(r.valid_to), utc(r.system_from))
                      for r in got.collect())
        assert len(seen) == len({x[:3] for x in seen})
        assert {(b[0], b[1], b[4]) for b in cut} == {(x[0], x[1], x[4]) for x in seen}
    for v in (D(2), D(11), None):
        want = sorted(((b[0], b[1], b[4], b[5]) for b in expected
                       if (b[3] is None if v is None else b[2] <= v and (b[3] is None or v < b[3]))), key=str)
        got = sorted(((r.id, r.is_fraud, utc(r.system_from), utc(r.system_to))
                      for r in versions(logs(spark, rows), Basis(valid_at=v)).collect()), key=str)
        assert got == want
        current = {(x[0], x[1]) for x in want if x[3] is None}
        assert {(r.id, r.is_fraud) for r in snapshot(logs(spark, rows), Basis(valid_at=v)).collect()} == current


def test_replayed_timeline_equals_general_one_and_rejects_other_logs(spark):
    rows = [label("a", False, D(1)), label("a", True, D(4)), label("a", None, D(6), op="del"), label("a", True, D(9)),
            label("b", False, D(2)), label("b", True, D(2), seq=1)]
    log = logs(spark, rows)
    pick = lambda df: sorted(map(str, df.select("id", "is_fraud", "valid_from", "valid_to").collect()))
    assert pick(replayed_timeline(log, Basis())) == pick(timeline(log, Basis()))
    for bad in (label("c", True, D(5), D(1), D(2)), label("a", True, D(12), D(3))):
        with pytest.raises(Exception, match="learned-at order"):
            replayed_timeline(logs(spark, rows + [bad]), Basis()).collect()
