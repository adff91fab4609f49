"""Ordered steps with a gate after each, and the journey workflow from a transcript to its phase files and map."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield import model
from loomfield.errors import EngineError
from loomfield.functions import text as T
from loomfield.operators import journey as J
from loomfield.operators.relational import with_retry
from loomfield.sources import markdown as M


# What is approved at which gate; the fifth has a gate after each of its steps.
GATES = {1: ("questionnaire",), 2: ("transcripts",), 3: ("mapped transcript",), 4: ("insights",), 5: ("extracted phases", "interpreted phases", "journey map"), 6: ("report",), 7: ("recipients", "draft")}


def approved(what: str) -> Callable[[dict], bool]:
    """A gate that opens by an answer of approval to `what` in state["approvals"], and only to what it was given for: an answer may name a digest, which must then be the one in state["digests"]."""
    if not any(what in names for names in GATES.values()):
        raise ValueError(f"no gate is for {what}")

    def opens(state: dict) -> bool:
        answer = state.get("approvals", {}).get(what)
        word, _, digest = str(answer or "").partition("@")
        return word.strip().lower() in model.APPROVALS and (not digest or digest == state.get("digests", {}).get(what))

    opens.what = what  # type: ignore[attr-defined]
    return opens


@dataclass
class Step:
    name: str
    run: Callable[[dict], dict]
    gate: Callable[[dict], bool] = lambda state: True
    needs: tuple[str, ...] = ()
    #: Files that the step reads and writes, by keys of the state; with them a manifest can tell that it needn't run again.
    reads: tuple[str, ...] = ()
    writes: tuple[str, ...] = ()


@dataclass
class Workflow:
    """Runs steps in order. A gate that refuses ends the run as `paused`; passing errors are tried once more.

    A step whose name is in `done` is skipped, as is one that the manifest (a JSON file) has with the same digests of the files that it
    reads and writes. A step that runs again makes those after it run again, as their inputs change. Gates are asked all the same.
    """

    steps: list[Step]
    done: set[str] = field(default_factory=set)
    manifest: str | None = None

    def run(self, state: dict) -> dict:
        seen = self._manifest()
        for s in self.steps:
            if s.name in self.done:
                continue
            kept = seen.get(s.name)
            if kept is not None and kept == self._digests(s, state | kept.get("state", {})) | {"state": kept.get("state", {})}:
                state = state | kept["state"]
            else:
                if missing := [k for k in s.needs if k not in state]:
                    raise EngineError("INVALID_INPUT", f"{s.name} needs {', '.join(missing)}")
                state = state | with_retry(lambda s=s: s.run(state))
                if self.manifest and s.writes:
                    seen[s.name] = self._digests(s, state) | {"state": {k: state[k] for k in s.writes}}
                    with open(self.manifest, "w", encoding="utf-8") as f:
                        json.dump(seen, f, sort_keys=True, indent=1)
            self.done.add(s.name)
            if not s.gate(state):
                return state | {"status": "paused", "at": s.name} | ({"gate": s.gate.what} if hasattr(s.gate, "what") else {})
        return state | {"status": "success"}

    def _manifest(self) -> dict:
        if not self.manifest or not os.path.exists(self.manifest):
            return {}
        try:
            with open(self.manifest, encoding="utf-8") as f:
                found = json.load(f)
        except ValueError:
            return {}
        return found if isinstance(found, dict) else {}

    @staticmethod
    def _digests(step: Step, state: dict) -> dict:
        return {part: {k: files_digest(state.get(k)) for k in keys} for part, keys in (("reads", step.reads), ("writes", step.writes))}


def files_digest(paths: str | list[str] | None) -> str | None:
    """One digest of some files' contents, in the order given; null if any isn't there."""
    if paths is None:
        return None
    digest = hashlib.sha256()
    for p in [paths] if isinstance(paths, str) else paths:
        if not os.path.isfile(p):
            return None
        with open(p, "rb") as f:
            digest.update(hashlib.file_digest(f, "sha256").digest())
    return digest.hexdigest()


def approval_token(recipients: list[str], body: str) -> str:
    """Bound to what is approved: another recipient or body needs another token."""
    return hashlib.sha256(json.dumps([sorted(recipients), body], ensure_ascii=False).encode()).hexdigest()


def routed(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(routed rows with phase and the original line, rejects) of mapped transcripts."""
    found = M.tables(M.lines(spark, *paths))
    columns: dict[str, list[str]] = {}
    for name in M.names_of(found):
        columns.setdefault(model.ALIASES.get(name, name), []).append(name)
    rows = M.named_rows(found, columns)
    v = model.variants(spark)
    lost = J.rejects(rows, v).select("doc", "line_no", "reason").join(found.select("doc", "line_no", F.col("line").alias("raw")), ["doc", "line_no"]).select("doc", "line_no", "raw", "reason")
    return J.route(rows, v), M.malformed(found).unionByName(lost)


def write_phase_files(spark: SparkSession, rows: DataFrame, header: list[str], folder: str) -> list[str]:
    """extracted-<phase>.md for all five phases; an empty one has its header only. One file's rows come to the driver at a time."""
    os.makedirs(folder, exist_ok=True)
    names = [model.ALIASES.get(h, h) for h in header]
    bodies = {r["phase"]: r["body"] for r in J.render(rows, ["phase"], "line_no", names).collect()}
    out = []
    for p in model.PHASES:
        path = os.path.join(folder, f"extracted-{p.replace(' ', '-')}.md")
        lines = ["| " + " | ".join(header) + " |", "|" + "---|" * len(header), *([bodies[p]] if bodies.get(p) else [])]
        with open(path, "w", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
        out.append(path)
    return out


def write_journey_map(map_rows: DataFrame, folder: str) -> str:
    """journey-map.md: six dimension rows by five phases."""
    path = os.path.join(folder, "journey-map.md")
    cells = lambda r: [r["dimension"], *(r[p] or "" for p in model.PHASES)]
    lines = ["| Dimension | " + " | ".join(p.title() for p in model.PHASES) + " |", "|" + "---|" * (1 + len(model.PHASES))]
    for r in map_rows.collect():
        lines.append("| " + " | ".join(c.replace("|", "\\|").replace("\n", "<br>") for c in cells(r)) + " |")
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return path


# Tabs in order.
TABS = ("Overview", "Insights", "Persona", "Transcript", "Journey Map")
STYLE = "body{font:15px sans-serif;margin:2em}input{display:none}label{padding:.4em 1em;border:1px solid #999;cursor:pointer}section{display:none}table{border-collapse:collapse;margin-top:1em}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:left;white-space:pre-line}"


def html_report(tabs: dict[str, DataFrame], path: str, project: str, inputs: dict[str, str | list[str]] | None = None) -> dict:
    """One page with a tab for each frame, those of TABS first and in their order, without scripts or other files. Tabs are small result tables, whose rows come to the driver.

    Returns the manifest: digests of the tabs, of the page, and of the files that each of `inputs` names.
    """
    names = [*(t for t in TABS if t in tabs), *(t for t in tabs if t not in TABS)]
    heads, bodies, manifest = [], [], {}
    for i, name in enumerate(names):
        frame = tabs[name]
        rows = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in frame.collect())
        section = f"<h2>{escape(name)}</h2><table><tr>" + "".join(f"<th>{escape(c)}</th>" for c in frame.columns) + f"</tr>{rows}</table>"
        heads.append(f'<input type="radio" name="tab" id="t{i}"{" checked" * (not i)}><label for="t{i}">{escape(name)}</label><style>#t{i}:checked~#s{i}{{display:block}}</style>')
        bodies.append(f'<section id="s{i}">{section}</section>')
        manifest[name] = hashlib.sha256(section.encode()).hexdigest()
    page = f"<!doctype html><meta charset=utf-8><title>{escape(project)}</title><style>{STYLE}</style><h1>{escape(project)}</h1>" + "".join(heads) + "".join(bodies)
    with open(path, "w", encoding="utf-8") as f:
        f.write(page)
    return {"tabs": manifest, "page": hashlib.sha256(page.encode()).hexdigest(), "inputs": {k: files_digest(v) for k, v in (inputs or {}).items()}}


def is_fresh(manifest: dict, path: str, inputs: dict[str, str | list[str]]) -> bool:
    """Is the page the one that the manifest is of, and are its inputs as they were?"""
    if not os.path.isfile(path):
        return False
    with open(path, "rb") as f:
        page = hashlib.sha256(f.read()).hexdigest()
    return page == manifest["page"] and manifest["inputs"] == {k: files_digest(v) for k, v in inputs.items()}


def interpretation_rows(texts: DataFrame) -> DataFrame:
    """(phase, dimension, value) from (doc, phase, value) files: fenced blocks are unwrapped first, rows are the pipe table's."""
    found = M.tables(M.split_lines(texts.select(F.col("phase").alias("doc"), T.fenced_block(F.col("value")).alias("value"))))
    rows = M.table_rows(found).where("size(cells) = 2")
    return rows.select(F.replace("doc", F.lit("-"), F.lit(" ")).alias("phase"), T.bare_label(F.get("cells", F.lit(0))).alias("dimension"), F.get("cells", F.lit(1)).alias("value"))
