"""Golden pairs: phase extraction, saturation, scorecards, and the journey map."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from loomfield import model
from loomfield.errors import EngineError
from loomfield.operators import journey as J
from loomfield.operators import questionnaire as Q
from loomfield.operators import saturation as S
from loomfield.operators import scorecard as K
from loomfield.plans import workflow as W
from loomfield.sources import files
from loomfield.sources import markdown as M

# The published example and its expected split.
MAPPED = """| # | Theme | Question | Response |
|---|---|---|---|
| 1 | 1. Awareness | How did you hear? | From a friend |
| 2 | 2. Consideration | Why choose us? | Good reviews |
| 3 | Awareness | Another channel | Online Ad |
| 4 | Usage | How do you use it? | Daily |
| 5 | 5. Advocacy | Recommend us? | Yes |
| 6 | 3. Decision Making | Decision? | Made it |
| 7 | Invalid Theme | Test | Test |
| 8 | Only 1 Col |
"""
# An invented study: who said what, and the grid that follows.
PEOPLE = ("Mia", "Noor", "Otto", "Pia", "Quinn")
SEEN = {"Mia": ("Pays by card", "Compares fees first", "Keeps receipts"), "Noor": ("Compares fees first", "Asks a friend"), "Otto": ("Pays by card",), "Pia": ("Sends at night", "Keeps receipts"), "Quinn": ("Asks a friend", "Pays by card")}
MATRIX = {"Pays by card": "N-R-R", "Compares fees first": "NR---", "Keeps receipts": "N--R-", "Asks a friend": "-N--R", "Sends at night": "---N-"}


def insights() -> str:
    parts = [f"# Insights — {p}\n| # | Insight | Quotes |\n|---|---|---|\n" + "".join(f'| {i} | {x} | "q" |\n' for i, x in enumerate(SEEN[p], 1)) for p in PEOPLE]
    return "\n".join(parts) + "\n## Summary of Discovered Insights\n" + "".join(f"- **{x}**: told often.\n" for x in MATRIX)


@pytest.fixture
def mapped(tmp_path):
    p = tmp_path / "mapped-transcript.md"
    p.write_text(MAPPED, encoding="utf-8")
    return str(p)


def test_phases(spark, mapped, tmp_path):
    rows, rejects = W.routed(spark, mapped)
    got = {}
    for r in rows.orderBy("line_no").collect():
        got.setdefault(r["phase"], []).append(r["question_no"])
    assert got == {"awareness": ["1", "3"], "consideration": ["2"], "decision making": ["6"], "usage": ["4"], "advocacy": ["5"]}
    assert sorted((r["reason"], r["line_no"]) for r in rejects.collect()) == [("MALFORMED_ROW", 10), ("UNKNOWN_THEME", 9)]
    paths = W.write_phase_files(spark, rows, ["#", "Theme", "Question", "Response"], str(tmp_path / "map"))
    with open(paths[0], encoding="utf-8") as f:
        assert f.read().splitlines() == MAPPED.splitlines()[:3] + [MAPPED.splitlines()[4]]
    assert [os.path.basename(p) for p in paths] == [f"extracted-{p.replace(' ', '-')}.md" for p in model.PHASES]
    again = files.phase_files(spark, str(tmp_path / "map"))
    assert {r["phase"] for r in again.collect()} == {p.replace(" ", "-") for p in model.PHASES}


def test_tables_with_columns_in_another_order(spark, tmp_path):
    (tmp_path / "mapped-transcript-1.md").write_text("| # | Theme | Question | Response |\n|---|---|---|---|\n| 1 | Usage | q1 | r1 |\n", encoding="utf-8")
    (tmp_path / "mapped-transcript-2.md").write_text("| Question | Theme |\n|---|---|\n| q2 | 1. Awareness |\n\n| STT | Giai đoạn | Ann |\n|---|---|---|\n| 3 | Advocacy | r3 |\n| 4 | Nowhere | r4 |\n", encoding="utf-8")
    rows, rejects = W.routed(spark, str(tmp_path / "mapped-transcript*.md"))
    got = {(r["phase"], r["question_no"], r["question"], r["response"], r["Ann"]) for r in rows.collect()}
    assert got == {("usage", "1", "q1", "r1", None), ("awareness", None, "q2", None, None), ("advocacy", "3", None, None, "r3")}
    assert [(r["raw"], r["reason"]) for r in rejects.collect()] == [("| 4 | Nowhere | r4 |", "UNKNOWN_THEME")]


def test_insights_of_several_documents(spark, tmp_path):
    for name, people in (("a", "Ann Bob"), ("b", "Bob Cid")):
        (tmp_path / f"{name}.md").write_text("\n".join(f"# Insights — {p}\n| # | Insight | Quotes |\n|---|---|---|\n| 1 | of {p} | q |\n" for p in people.split()), encoding="utf-8")
    rows = M.insight_observations(M.lines(spark, str(tmp_path / "*.md"))).collect()
    assert sorted((os.path.basename(r["doc"]), r["participant_ord"], r["participant"]) for r in rows) == [("a.md", 1, "Ann"), ("a.md", 2, "Bob"), ("b.md", 1, "Bob"), ("b.md", 2, "Cid")]


def test_counts_keep_empty_phases(spark, mapped):
    rows, _ = W.routed(spark, mapped)
    counts = J.counts(rows.where("phase <> 'usage'"), model.phases(spark)).collect()
    assert [(r["phase"], r["n"]) for r in counts] == [("awareness", 2), ("consideration", 1), ("decision making", 1), ("usage", 0), ("advocacy", 1)]


def test_theme_is_needed_and_topic_is_no_theme(spark):
    rows = J.canonical(spark.createDataFrame([(1, "Usability")], "`#` int, Topic string"))
    with pytest.raises(EngineError, match="MISSING_COLUMN"):
        J.route(rows, model.variants(spark))


def test_variants_are_exact(spark):
    rows = spark.createDataFrame([("7. Awareness",), (" AWARENESS ",), ("0. Warm-up",), (None,)], "theme string")
    assert J.route(rows, model.variants(spark)).count() == 1


def test_saturation(spark, tmp_path):
    p = tmp_path / "insights.md"
    p.write_text(insights(), encoding="utf-8")
    lines = M.lines(spark, str(p))
    obs = M.insight_observations(lines)
    assert obs.count() == 10
    n = S.curve(obs).orderBy("participant_ord").collect()
    assert [r["participant"] for r in n] == list(PEOPLE)
    assert [r["new_insights"] for r in n] == [3, 1, 0, 1, 0]
    assert [r["total_insights"] for r in n] == [3, 4, 4, 5, 5]
    wide = {r["insight"]: [r[x] for x in PEOPLE] for r in S.matrix_wide(S.matrix(obs), list(PEOPLE)).collect()}
    assert wide == {k: [{"N": "NEW", "R": "REPEAT", "-": "ABSENT"}[c] for c in v] for k, v in MATRIX.items()}
    assert S.summary_mismatch(M.summary_bullets(lines), obs).count() == 0
    s = S.summary(obs).first()
    assert (s["insights"], s["participants"], s["last_new_ord"]) == (5, 5, 4)
    # saying it twice or in another order changes no total
    assert S.new_per_participant(obs.union(obs)).agg(F.sum("new_insights")).first()[0] == 5
    assert S.new_per_participant(obs.withColumn("participant_ord", -F.col("participant_ord"))).agg(F.sum("new_insights")).first()[0] == 5


def test_matrix_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "PEOPLE_BLOCK", 3)
    rows = [(p, f"p{p}", f"i{(p * k) % 7}") for p in range(20) for k in range(3)]
    obs = spark.createDataFrame(rows, "participant_ord int, participant string, insight string")
    first = {}
    for p, _, i in rows:
        first[i] = min(p, first.get(i, p))
    said = {(i, p) for p, _, i in rows}
    want = {(i, p, "ABSENT" if (i, p) not in said else "NEW" if first[i] == p else "REPEAT") for i in first for p in range(20)}
    got = S.matrix(obs).collect()
    assert len(got) == len(want) and {(r["insight"], r["participant_ord"], r["mark"]) for r in got} == want


@pytest.mark.parametrize(("accuracy", "many"), [(10, 2), (50, 20_000), (100_000, 20_000), (100_000, 2)])
def test_quantiles(spark, monkeypatch, accuracy, many):
    """Brackets that are broadcast, and ones that are joined, with groups that are parted."""
    import numpy as np

    from loomfield.operators import profile as P
    from loomfield.operators import skew

    monkeypatch.setattr(P, "ACCURACY", accuracy)
    monkeypatch.setattr(P, "MANY_GROUPS", many)
    monkeypatch.setattr(skew, "LEAST", 50)
    r = np.random.default_rng(5)
    groups = {"even": r.normal(0, 1, 500), "ties": r.integers(0, 4, 300).astype(float), "tail": np.exp(r.normal(0, 6, 400)), "one": np.array([7.0]), "two": np.array([1.0, 4.0]), None: r.uniform(0, 1, 33)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("none", None), ("one", None)]
    d = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {x["g"]: x for x in P.quantiles(d, ["g"], "x", (0.25, 0.5, 0.75, 1.0)).collect()}
    assert got["none"]["q"] is None and set(got) == {*groups, "none"}
    for g, v in groups.items():
        assert np.allclose(got[g]["q"], np.quantile(v, [0.25, 0.5, 0.75, 1.0]), rtol=1e-12), g
        assert (got[g]["n"], got[g]["min"], got[g]["max"]) == (len(v), v.min(), v.max())
    assert P.describe(d.where("g = 'two'"), "x").first()["median"] == 2.5 and P.describe(d.limit(0), "x").first()["n"] == 0


def test_sources(spark, tmp_path):
    from loomfield.catalog import read, write

    rows = spark.createDataFrame([(1, 'a "q", b\nc', "x"), (2, None, "y")], "id bigint, text string, part string")
    for end in ("parquet", "orc", "json", "csv", "tsv"):
        path = str(tmp_path / f"t.{end}")
        write(rows, path)
        assert sorted(read(spark, path, schema=None if end in ("parquet", "orc") else "id bigint, text string, part string").select("id", "text", "part").collect(), key=lambda r: r["id"]) == rows.collect(), end
    write(rows, str(tmp_path / "parts"), by=("part",))
    assert read(spark, str(tmp_path / "parts")).where("part = 'x'").count() == 1


def test_chart(spark, tmp_path):
    from xml.etree import ElementTree

    from loomfield.plans.chart import saturation_chart

    obs = spark.createDataFrame([(i, f"<{p}>", x) for i, p in enumerate(PEOPLE, 1) for x in SEEN[p]], "participant_ord int, participant string, insight string")
    root = ElementTree.parse(saturation_chart(S.curve(obs), str(tmp_path / "c.svg"))).getroot()
    svg = "{http://www.w3.org/2000/svg}"
    heights = [float(r.get("height")) for r in root.iter(f"{svg}rect")]
    ends = [float(p.split(",")[1]) for p in root.find(f"{svg}polyline").get("points").split()]
    assert [round(5 * h / 280) for h in heights] == [3, 1, 0, 1, 0] and [round(5 * (320 - y) / 280) for y in ends] == [3, 4, 4, 5, 5]
    empty = ElementTree.parse(saturation_chart(S.curve(obs.limit(0)), str(tmp_path / "e.svg"))).getroot()
    assert not list(empty.iter(f"{svg}rect"))


def test_curve_keeps_a_null_participant(spark):
    rows = [(1, "1", "a"), (2, "2", "b"), (70_000, "70000", "c"), (None, None, "a"), (None, None, "d")]
    got = S.curve(spark.createDataFrame(rows, "participant_ord bigint, participant string, insight string")).collect()
    assert {(r["participant_ord"], r["new_insights"], r["total_insights"]) for r in got} == {(1, 1, 1), (2, 1, 2), (70_000, 1, 3), (None, 1, 4)}


def test_empty_saturation(spark):
    empty = spark.createDataFrame([], "participant_ord int, participant string, insight string")
    assert S.curve(empty).count() == 0
    assert S.matrix(empty).count() == 0


def test_wide_transcript(spark):
    rows = spark.createDataFrame([("1", "N/A", "None"), ("2", None, "x")], "question_no string, Ann string, Bob string")
    long = J.wide_to_long(rows, ["question_no"]).collect()
    assert {(r["question_no"], r["participant"], r["participant_ord"], r["answer"]) for r in long} == {("1", "Ann", 1, "N/A"), ("1", "Bob", 2, "None"), ("2", "Ann", 1, None), ("2", "Bob", 2, "x")}


def test_scorecard(spark, tmp_path):
    card = {"speed": {"time": {"score": "9/10", "analysis": "a", "solutions": ["No improvement needed."]}, "memory": {"score": "8/10", "analysis": "b", "solutions": ["Stream it."]}}, "cost": {"calls": {"score": "10/10", "analysis": "c", "solutions": ["No improvement needed."]}}}
    (tmp_path / "card.json").write_text(json.dumps(card, indent=1), encoding="utf-8")
    scores = K.explode_scores(files.scorecards(spark, str(tmp_path / "card.json")))
    r = {x["category"]: (x["points"], x["possible"], x["criteria"]) for x in K.rollup(scores).collect()}
    assert r == {"speed": (17, 20, 2), "cost": (10, 10, 1), None: (27, 30, 3)}
    assert [x["criterion"] for x in K.with_solutions(scores).collect()] == ["memory"]


def test_questionnaire(spark):
    q = spark.createDataFrame([(1, "0. Warm-up", "a\nb"), (2, "1. Awareness", "c")], "question_no int, theme string, targets string")
    assert [(r["question_no"], r["target_no"], r["target"]) for r in Q.targets(q).orderBy("question_no", "target_no").collect()] == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]
    themes = spark.createDataFrame([(t,) for t in model.THEMES[1:]], "theme string")
    assert [r["question_no"] for r in Q.outside_domain(q, themes, "theme").collect()] == [1]
    assert Q.answers(q, spark.createDataFrame([(2, "yes")], "question_no int, answer string")).where("answer IS NULL").count() == 1


def test_evidence_finds_short_and_long_quotes(spark):
    long = "one two three four five six seven eight nine"
    texts = spark.createDataFrame([(1, f"xx{long}yy and more"), (2, "nothing at all"), (3, None)], "doc int, text string")
    quotes = spark.createDataFrame([(10, long), (11, "at all"), (12, "absent"), (13, None)], "item int, quote string")
    assert {tuple(r) for r in Q.evidence(texts, quotes, "text", "quote", "doc", "item").collect()} == {(1, 10), (2, 11)}


def test_journey_map(spark, tmp_path):
    body = "```markdown\n| Dimension | Value |\n|---|---|\n| **Stage Goal** | find |\n| Stage Emotion (1-5) | 7 |\n```"
    (tmp_path / "interpret-awareness.md").write_text(body, encoding="utf-8")
    rows = W.interpretation_rows(files.phase_files(spark, str(tmp_path), "interpret"))
    m = J.journey_map(rows, model.phases(spark), model.dimensions(spark)).collect()
    assert len(m) == 6 and m[0]["awareness"] == "find" and m[0]["usage"] == ""
    found = J.check_interpretations(rows, model.phases(spark), model.dimensions(spark)).groupBy("finding").count().collect()
    assert {r["finding"]: r["count"] for r in found} == {"missing": 28, "emotion out of range": 1}
    path = W.write_journey_map(J.journey_map(rows, model.phases(spark), model.dimensions(spark)), str(tmp_path))
    with open(path, encoding="utf-8") as f:
        assert len(f.read().splitlines()) == 8


def test_gates_retry_and_skip():
    tries = []

    def shaky(state):
        tries.append(1)
        if len(tries) == 1:
            raise EngineError("TIMEOUT")
        return {"a": 1}

    flow = W.Workflow([W.Step("one", shaky), W.Step("two", lambda s: {"b": 2}, gate=lambda s: False, needs=("a",)), W.Step("three", lambda s: {"c": 3})])
    assert flow.run({})["at"] == "two"
    assert flow.run({"a": 1})["c"] == 3 and len(tries) == 2
    with pytest.raises(EngineError, match="INVALID_INPUT"):
        W.Workflow([W.Step("x", lambda s: {}, needs=("z",))]).run({})
    assert W.approval_token(["a"], "x") != W.approval_token(["a"], "y")


def test_named_gates_and_a_manifest(tmp_path):
    with pytest.raises(ValueError, match="no gate"):
        W.approved("lunch")
    ran = []

    def write(name, text):
        def step(state):
            ran.append(name)
            (tmp_path / name).write_text(text + "".join((tmp_path / x).read_text() for x in state.get("from", [])))
            return {name: str(tmp_path / name)}

        return step

    (tmp_path / "in").write_text("input")
    flow = lambda: W.Workflow([W.Step("one", write("a", "x"), W.approved("insights"), reads=("in",), writes=("a",)), W.Step("two", write("b", "y"), W.approved("report"), needs=("a",), reads=("a",), writes=("b",))], manifest=str(tmp_path / "m.json"))
    state = {"in": str(tmp_path / "in")}
    out = flow().run(state)
    assert (out["status"], out["at"], out["gate"]) == ("paused", "one", "insights") and ran == ["a"]
    digest = W.files_digest(str(tmp_path / "a"))
    yes = state | {"approvals": {"insights": f"OK@{digest}", "report": " gửi "}, "digests": {"insights": digest}}
    assert flow().run(yes)["status"] == "success" and ran == ["a", "b"]  # the first step's file is there
    assert flow().run(yes)["status"] == "success" and ran == ["a", "b"]
    assert flow().run(yes | {"digests": {"insights": "another"}})["status"] == "paused"
    (tmp_path / "in").write_text("changed")
    assert flow().run(yes)["status"] == "success" and ran == ["a", "b", "a"]  # its output is as it was, so the second needn't run
    (tmp_path / "b").write_text("touched")
    assert flow().run(yes)["status"] == "success" and ran == ["a", "b", "a", "b"]


def test_task_input():
    assert files.task('{"insights_path": "a", "transcript_path": "b", "output_dir": "/x/Demo"}')["project_name"] == "Demo"
    with pytest.raises(EngineError, match="INVALID_INPUT"):
        files.task("{}")


def test_media_and_transcripts(spark, tmp_path):
    for n in ("a.MP3", "b.txt", "c.m4a"):
        (tmp_path / n).write_bytes(b"x")
    assert sorted(r["stem"] for r in files.media(spark, str(tmp_path)).collect()) == ["a", "c"]
    (tmp_path / "transcript_a.md").write_text("[00:01:05] Ann: hello\nplain", encoding="utf-8")
    assert [(r["second"], r["speaker"], r["said"]) for r in files.transcripts(spark, str(tmp_path)).orderBy("line_no").collect()] == [(65, "Ann", "hello"), (None, None, "plain")]


def test_html_report(spark, tmp_path):
    (tmp_path / "in").write_text("x")
    inputs = {"insights": str(tmp_path / "in")}
    many = {"More": spark.range(1), "Journey Map": spark.range(1), "Overview": spark.range(2)}
    m = W.html_report(many, str(tmp_path / "many.html"), "P", inputs)
    text = (tmp_path / "many.html").read_text(encoding="utf-8")
    assert text.index("Overview") < text.index("Journey Map") < text.index("More") and text.count("<section") == 3 and list(m["tabs"]) == ["Overview", "Journey Map", "More"]
    assert W.is_fresh(m, str(tmp_path / "many.html"), inputs)
    (tmp_path / "in").write_text("y")
    assert not W.is_fresh(m, str(tmp_path / "many.html"), inputs) and not W.is_fresh(m, str(tmp_path / "none.html"), inputs)
    a = W.html_report({"Overview": spark.range(2)}, str(tmp_path / "r.html"), "P <1>")
    assert a == W.html_report({"Overview": spark.range(2)}, str(tmp_path / "r.html"), "P <1>")
    assert "P &lt;1&gt;" in (tmp_path / "r.html").read_text(encoding="utf-8")
