"""Corrections of author lists from a second source: affiliations by name, missing authors appended, with a change log.

One join on the record brings both sides together; lists are corrected record by record in one Arrow pass, because the
fuzzy match of names has no relational form. Author lists that cannot be read are left as they are.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions import similarity as sim
from sievewright.operators.merge import named_map
from sievewright.session import arrow_map

#: Least ratio of two names of one author.
LEAST = 80.0


def name_form(name: str | None) -> str:
    return "".join(c.lower() if c.isalnum() or c.isspace() else " " for c in name or "")


def best_name(name: str | None, others: list[str], least: float = LEAST) -> str | None:
    """The other name with the highest token set ratio, the first of equal ones; None below `least` or for a blank name."""
    form = name_form(name)
    if not form.strip():
        return None
    ratios = [sim.token_set_ratio(form, name_form(o)) for o in others]
    top = max(ratios, default=0.0)
    return others[ratios.index(top)] if others and top >= least else None


def correct_authors(cell: str | None, known: list[tuple[str, list[str]]]) -> tuple[str | None, list[tuple[str, str, str, str]]]:
    """The corrected author cell and its changes (operation, author, old, new affiliations).

    An empty list takes all known authors; else affiliations of matched authors are replaced, and known authors that no
    author of the list resembles are appended.
    """
    places = {name: "; ".join(affs) for name, affs in known}
    fresh = lambda name: {"name": name, "rasses": places[name], "corresponding_author": False}
    if not (cell or "").strip():
        authors = []
    else:
        try:
            authors = json.loads(cell)
        except ValueError:
            return cell, []
        if not isinstance(authors, list):
            return cell, []
    if not authors:
        return json.dumps([fresh(n) for n in places], ensure_ascii=False), [("populate", n, "", places[n]) for n in places]
    changes, used = [], set()
    people = [a for a in authors if isinstance(a, dict) and a.get("name")]
    for a in people:
        match = best_name(a["name"], list(places))
        old = a.get("rasses") or ""
        if match is not None and places[match] != old:
            used.add(match)
            a["rasses"] = places[match]
            changes.append(("overwrite", a["name"], old, places[match]))
    for name in places:
        if name not in used and not any(best_name(name, [a["name"]]) for a in people):
            people.append(fresh(name))
            authors.append(people[-1])
            changes.append(("append", name, "", places[name]))
    return json.dumps(authors, ensure_ascii=False), changes


def fixes(deltas: DataFrame, field: str) -> DataFrame:
    """doi and known authors of the rows that ask for a correction of a field; the last one (by seq) of a doi wins."""
    wanted = deltas.where((F.col("suggested_action") == "fix_gold") & (F.col("field") == field) & (F.coalesce(F.trim("doi"), F.lit("")) != ""))
    last = wanted.groupBy(F.trim("doi").alias("doi")).agg(F.max_by("parser_value", "seq").alias("cell"))
    named = F.filter(named_map(F.col("cell")), lambda e: F.size(F.filter(e["affiliations"], lambda x: F.coalesce(x, F.lit("")) != "")) > 0)
    return last.select("doi", named.alias("known"))


def apply_fixes(gold: DataFrame, deltas: DataFrame, field: str = "affiliations") -> DataFrame:
    """Gold rows (doi, authors cell) with corrected cells and `changes`; rows without a correction keep theirs."""
    joined = gold.select("doi", F.col("authors")).join(fixes(deltas, field), "doi", "left")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells, logs = [], []
        for cell, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            fixed, changes = (cell, []) if known is None else correct_authors(cell, [(k["name"], [a for a in k["affiliations"] if a]) for k in known])
            cells.append(fixed)
            logs.append([dict(zip(("operation", "author", "old", "new"), c, strict=True)) for c in changes])
        kind = pa.list_(pa.struct([(n, pa.string()) for n in ("operation", "author", "old", "new")]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.string()), pa.array(logs, kind)], ["doi", "authors", "changes"])

    return arrow_map(joined, kernel, "doi string, authors string, changes array<struct<operation:string,author:string,old:string,new:string>>")


def with_fallback(rows: DataFrame, second: DataFrame, key: str, fields: list[str], label: str) -> DataFrame:
    """Rows whose empty fields are filled from a second attempt; such rows say so in their notes, once, and have status TRUE."""
    from sievewright.functions import text as tx
    from sievewright.operators.audit import appended

    other = second.select(key, *[F.col(f).alias(f"s_{f}") for f in fields])
    both = rows.join(other, key, "left")
    can = {f: tx.absent_list(F.col(f)) & ~tx.absent_list(F.col(f"s_{f}")) for f in fields}
    filled = F.lit(False)
    for c in can.values():
        filled = filled | c
    made = {f: F.when(can[f], F.col(f"s_{f}")).otherwise(F.col(f)) for f in fields}
    made["notes"] = F.when(filled, appended(F.col("notes"), F.lit(label))).otherwise(F.col("notes"))
    made["status"] = F.when(filled, "TRUE").otherwise(F.col("status"))
    return both.withColumns(made).select(*rows.columns)


def character_changes(df: DataFrame, left: str, right: str, keys: list[str]) -> DataFrame:
    """(keys, `op`, `left_start`, `left_end`, `right_start`, `right_end`): the edit script between two texts, equal parts left out."""
    import difflib

    chosen = df.select(*keys, F.coalesce(left, F.lit("")).alias("l"), F.coalesce(right, F.lit("")).alias("r"))
    kinds = dict(chosen.dtypes)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = len(keys)
        rows, ops = [], []
        for i, (a, b) in enumerate(zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)):
            for op in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
                if op[0] != "equal":
                    rows.append(i)
                    ops.append(op)
        take = pa.array(rows, pa.int64())
        spans = [pa.array([o[k] for o in ops], pa.string() if k == 0 else pa.int32()) for k in range(5)]
        return pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(n)), *spans], [*keys, "op", "left_start", "left_end", "right_start", "right_end"])

    return arrow_map(chosen, kernel, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", op string, left_start int, left_end int, right_start int, right_end int")
