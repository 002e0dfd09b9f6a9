import hashlib

import pytest

from quillon.llm import line_dedup
from quillon.llm.line_dedup import LineRuns


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows):
    rows = [(-(2**63) if d is None else d, t or "") for d, t in rows]
    owner = {}
    for d, t in sorted(rows):
        for line in t.split("\n"):
            owner.setdefault(key(line), d)
    out = []
    for d, t in rows:
        kept = [x for x in t.split("\n") if len(key(x)) < 10 or owner[key(x)] == d]
        n = t.count("\n") + 1
        out.append((d, n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 3, 9])
def test_odd_rows(odd, odd_rows, batches):
    got = line_dedup.deduplicated(odd.select("doc_id", "text"), batches)
    from pyspark.sql import functions as F

    rows = got.select("doc_id", "qn_lines", "qn_dropped", F.sha2("qn_kept", 256)).collect()
    assert sorted((-(2**63) if r[0] is None else r[0], *r[1:]) for r in rows) == brute([(r[0], r[1]) for r in odd_rows])


def test_empty_table_and_columns(odd, none):
    assert line_dedup.digests(none).count() == 0
    out = line_dedup.rewritten(odd)
    assert out.columns == odd.columns
    row = out.where("doc_id = 16").first()
    assert row.text == "short" and row.n_chars == 5
    assert out.where("doc_id = 8").first().text is None


def test_same_id_with_other_texts(spark):
    docs = spark.createDataFrame([(1, "first common line\nx"), (2, "x\nfirst common line"), (2, "first common line\nown line of two")], "doc_id long, text string")
    assert sorted(r.qn_kept for r in line_dedup.deduplicated(docs).collect()) == ["first common line\nx", "own line of two", "x"]


def test_runs_are_levelled_and_hold_each_hash_once(spark):
    with LineRuns(spark, buckets=2) as runs:
        for i in range(5):
            runs.add(spark.createDataFrame([(10 * i + j, h, h) for j, h in enumerate((1, i, i + 1))], "doc long, h1 long, h2 long"))
        assert all(len(level) < line_dedup.FANOUT for level in runs.levels)
        found = [tuple(r) for r in runs.owners().select("h1", "owner").collect()]
        names = list(runs.paths)
    assert sorted(h for h, _ in found) == [0, 1, 2, 3, 4, 5] and dict(found)[1] == 0 and dict(found)[4] == 32
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_runs_go_when_a_step_fails(spark, odd, monkeypatch):
    monkeypatch.setattr(LineRuns, "owners", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        line_dedup.digests(odd)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quillon_line_run")]


def test_clashing_names(odd):
    from pyspark.sql import functions as F

    clash = odd.withColumns({x: F.lit(7) for x in ("qn_doc", "qn_body", "qn_gone", "QN_kept", "qn_lines", "qn_dropped", "doc", "h1", "a.b")})
    out = line_dedup.rewritten(clash)
    assert out.columns == clash.columns and out.where("doc_id = 16").first().text == "short"
    assert {r.qn_doc for r in out.collect()} == {7}
    assert line_dedup.added(clash) == ["qn_lines_", "qn_dropped_", "qn_kept_"]
    assert line_dedup.deduplicated(clash).where("doc_id = 16").first().qn_kept_ == "short"


def test_main_path_has_no_python(odd):
    plan = line_dedup.digests(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
