"""Parsers of whole text files: each file is a row, parsed in a task."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from cladeflow.operators.trees import parse_newick

_TOKEN = re.compile(r"'[^']*'|\"[^\"]*\"|[^\s]+")


def phylip(text: str) -> list[tuple[str, str]]:
    """Sequential or interleaved PHYLIP: a line `taxa sites`, then names with letters; later
    blocks continue the taxa in order."""
    lines = [x.rstrip() for x in text.splitlines()]
    lines = lines[next((i for i, x in enumerate(lines) if x.strip()), len(lines)) :]
    head = lines[0].split() if lines else []
    if len(head) < 2 or not (head[0].isdigit() and head[1].isdigit()):
        return []
    taxa, sites = int(head[0]), int(head[1])
    names: list[str] = []
    parts: list[list[str]] = []
    turn = 0
    for line in lines[1:]:
        if not line.strip():
            continue
        pending = len(parts) and sum(map(len, parts[-1])) < sites and len(names) < taxa and not re.match(r"^\S+\s+\S", line)
        if len(names) < taxa and not pending:
            name, _, rest = line.strip().partition(" ")
            names.append(name)
            parts.append(["".join(rest.split())])
        elif pending:
            parts[-1].append("".join(line.split()))
        else:
            while sum(map(len, parts[turn % taxa])) >= sites and turn < 100 * taxa:
                turn += 1
            parts[turn % taxa].append("".join(line.split()))
            turn += 1
    return [(n, _plain_letters("".join(p))) for n, p in zip(names, parts, strict=True)]


def _block(text: str, name: str) -> str:
    m = re.search(rf"begin\s+{name}\s*;(.*?)\bend\s*;", text, re.I | re.S)
    return m[1] if m else ""


def nexus(text: str) -> list[tuple[str, str]]:
    """The matrix of a NEXUS file; interleaved parts are appended; without labels in the matrix,
    those of the taxa block are used."""
    text = re.sub(r"\[[^\]]*\]", "", text)
    body = _block(text, "data") or _block(text, "characters")
    m = re.search(r"\bmatrix\b(.*?);", body, re.I | re.S)
    if not m:
        return []
    lines = [x.strip() for x in m[1].splitlines() if x.strip()]
    if re.search(r"\bnolabels\b", body, re.I):
        labels = re.search(r"\btaxlabels\b(.*?);", text, re.I | re.S)
        names = [x.strip("'\"") for x in _TOKEN.findall(labels[1])] if labels else []
        return [(n, _plain_letters(s)) for n, s in zip(names, lines, strict=False)]
    out: dict[str, str] = {}
    for line in lines:
        t = _TOKEN.match(line)
        name = t[0].strip("'\"")
        out[name] = out.get(name, "") + _plain_letters(line[t.end() :])
    return list(out.items())


def embedded_newick(text: str) -> str:
    """The first tree of a text: of a NEXUS trees block, or the first line that starts with a parenthesis."""
    m = re.search(r"\btree\s+[^=;]+=\s*(?:\[[^\]]*\]\s*)*(\(.*?;)", text, re.I | re.S)
    if m:
        return m[1]
    return next((x.strip() for x in text.splitlines() if x.strip().startswith("(")), "")


def newick(text: str) -> list[tuple]:
    return parse_newick(embedded_newick(text))


def written_year(text: str | float | None) -> float | None:
    """A decimal year from 1800 to 2100, as a number or a calendar date: year first, or day or month first with a year of four digits; a day
    means its start, a month without day its fifteenth, a year alone (as a date) the fifteenth of June."""
    s = str(text if text is not None else "").strip().strip("'\"")
    try:
        v = float(s)
    except ValueError:
        pass
    else:
        if 1800 <= v <= 2100:
            return v
    parts = re.split("[-/.]", s)
    number = lambda x: int(x) if x.isdigit() else None
    if re.fullmatch(r"\d{4}", parts[0]):
        y, m, d = (number(x) for x in (parts + ["", ""])[:3])
        m, d = (m if m and m <= 12 else 6), (d if d and d <= 31 else 15)
    elif len(parts) in (2, 3) and all(x.isdigit() for x in parts) and len(parts[-1]) == 4:
        y, first, second = int(parts[-1]), int(parts[0]), int(parts[-2])
        m, d = (first, 15) if len(parts) == 2 else (second, first) if 1 <= second <= 12 else (first, second)
        if not (1 <= m <= 12 and 1 <= d <= 31):
            return None
    else:
        return None
    if not 1800 <= y <= 2100:
        return None
    day = date(y, m, min(d, 28 if m == 2 else 30))
    return y + (day - date(y, 1, 1)).days / (date(y + 1, 1, 1) - date(y, 1, 1)).days


def _plain_letters(text: str) -> str:
    return "".join(text.split()).upper().replace("U", "T")


def beast_xml(text: str) -> list[tuple[str, str | None, float | None]]:
    """(taxon, sequence, date): sequences of either dialect, of the alignment with most of them; dates of taxa or of a date
    trait, as numbers or calendar dates, its entries between commas, semicolons or lines. A `seq_` before a name is taken off where
    the dates know the name without it; U counts as T."""
    root = ET.fromstring(text)
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    best: dict[str, str] = {}
    dates: dict[str, float] = {}
    for block in [e for e in root.iter() if local(e) in ("alignment", "data")] or [root]:
        seqs: dict[str, str] = {}
        for e in block.iter():
            if local(e) == "sequence":
                ref = next((x for x in e if local(x) == "taxon"), None)
                name = (ref.get("idref") or ref.get("id") if ref is not None else None) or e.get("taxon") or e.get("id")
                letters = _plain_letters(e.get("value") or "".join(e.itertext()))
                if name and letters:
                    seqs[name.strip("'\"")] = seqs.get(name.strip("'\""), "") + letters
        if len(seqs) > len(best):
            best = seqs
    for e in root.iter():
        if local(e) == "taxon" and (name := e.get("id") or e.get("idref")):
            when = next((x for x in e if local(x) == "date"), None)
            at = written_year(when.get("value") or when.text if when is not None else e.get("date"))
            if at is not None:
                dates[name.strip("'\"")] = at
        elif local(e) == "trait" and "date" in (e.get("traitname") or e.get("name") or "").lower():
            for item in re.split(r"[,;\n\r]+", e.get("value") or e.text or ""):
                k, eq, v = item.partition("=")
                at = written_year(v) if eq else None
                if at is not None:
                    dates[k.strip().strip("'\"")] = at
    named = {n[4:] if n not in dates and n.startswith("seq_") and n[4:] in dates else n: s for n, s in best.items()}
    date_of = lambda n: dates.get(n, dates.get(f"seq_{n}"))
    spare = [n for n in dates if n not in named and n.removeprefix("seq_") not in named]
    return [(n, named.get(n), date_of(n)) for n in [*named, *spare]]


def beast_tree(text: str) -> str:
    """The starting tree of such a document, without comments, or an empty text: the first element or attribute that holds one."""
    for e in ET.fromstring(text).iter():
        held = (e.text or "").strip()
        named = next((v.strip() for k, v in e.attrib.items() if "newick" in k.lower() and v.strip().startswith("(")), "")
        if held.startswith("(") and ("newick" in e.tag.lower() or held.endswith(";")):
            named = held
        if named:
            return re.sub(r"\[&[^\]]*\]|\{[^}]*\}", "", named).rstrip(";") + ";"
    return ""


def auspice(text: str) -> list[tuple[str, float | None, str | None, str | None]]:
    """(tip, numeric date, date as text, location) of a v2 tree, within a document or bare; inner nodes are passed through. A tip without a date
    attribute has the one its name ends in after the last `|`, if that is one."""
    doc = json.loads(text)
    out = []
    stack = [doc.get("tree", doc)]
    value = lambda x: x.get("value") if isinstance(x, dict) else x
    while stack:
        n = stack.pop()
        kids = n.get("children") or []
        stack.extend(reversed(kids))
        if not kids and n.get("name"):
            a = n.get("node_attrs", {})
            num = value(a.get("num_date"))
            when = value(a.get("date")) or value(a.get("year"))
            place = next((value(a[k]) for k in ("location", "division", "country", "region") if k in a), None)
            num = float(num) if num is not None else None
            if num is None and when is None and "|" in n["name"]:
                num = written_year(n["name"].rsplit("|", 1)[1])
            out.append((n["name"], num, str(when) if when is not None else None, place))
    return out


def site_tests(text: str) -> list[tuple[int, float, float]]:
    """(site from 1, statistic, p) of a site-test JSON: columns found by their headers, else by
    place; partitions are mapped to sites by their coverage; negative statistics count as 0."""
    doc = json.loads(text)
    mle = doc["MLE"]
    heads = [h[0].strip().lower() if isinstance(h, list) else str(h).strip().lower() for h in mle.get("headers", [])]
    lrt = next((i for i, h in enumerate(heads) if h == "lrt"), 5)
    p = next((i for i, h in enumerate(heads) if h == "p-value"), 6)
    out = []
    for part, rows in mle["content"].items():
        cover = (doc.get("data partitions", {}).get(part, {}).get("coverage") or [list(range(len(rows)))])[0]
        out += [(int(site) + 1, max(float(r[lrt]), 0.0), float(r[p])) for site, r in zip(cover, rows, strict=True)]
    return out


def read_files(spark: SparkSession, path: str, parse: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """path, ord (from 0) and the parser's columns, for every file under `path`. gzip is read by its suffix."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    files = spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path as path", "value")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for where, text in zip(f["path"], f["value"], strict=True):
                rows = pd.DataFrame(parse(text), columns=names)
                rows.insert(0, "ord", range(len(rows)))
                rows.insert(0, "path", where)
                yield rows

    return files.mapInPandas(work, f"path string, ord long, {schema}")


def clock_xml(rows: list[tuple[str, str, float]], newick_text: str, rate: float) -> str:
    """A starting document for a sampler: dated taxa, alignment, starting tree and clock rate. Rows of one
    analysis, which fits the driver."""
    from xml.sax.saxutils import escape, quoteattr

    taxa = "\n".join(f"  <taxon id={quoteattr(n)}><date value=\"{t:.6f}\" direction=\"forwards\" units=\"years\"/></taxon>" for n, _, t in rows)
    seqs = "\n".join(f"  <sequence><taxon idref={quoteattr(n)}/>{escape(s)}</sequence>" for n, s, _ in rows)
    return f'<?xml version="1.0"?>\n<beast>\n<taxa id="taxa">\n{taxa}\n</taxa>\n<alignment id="alignment" dataType="nucleotide">\n{seqs}\n</alignment>\n<newick id="startingTree">{escape(newick_text)}</newick>\n<strictClockBranchRates id="branchRates"><rate><parameter id="clock.rate" value="{rate:.8g}"/></rate></strictClockBranchRates>\n</beast>\n'
