"""References to records that do not exist, directly or by inheritance."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.functions.times import micros, month
from cladeflow.operators.prefix_sums import running_sums
from cladeflow.session import stored

#: fixed values: what counts as white space around a name
BLANKS = " \t\n\r\x0b\x0c "


def loose_name(c: Column | str) -> Column:
    """A name as it is compared: trimmed, lower case, `/` and blank read as `_`; null if blank."""
    c = F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))
    return F.when(F.length(c) > 0, F.translate(F.lower(c), "/ ", "__"))


@dataclass(frozen=True)
class References:
    """A table of references: which rows (row_id), to which key, loaded when."""

    tab: str
    df: DataFrame
    row_id: str
    key: str
    loaded_at: str


def references_at_load(records: DataFrame, name: str, loaded_at: str, withdrawn_at: str, refs: list[References], parts: int | None = None, compare=loose_name, row_type: str = "long") -> DataFrame:
    """Judge every reference at the moment it was loaded.

    Result: tab, load_month (`YYYY-MM`), row_id, reason; one row per reference that
    is not in order. `missing`: no record of that name at all; `late`: a record of
    that name is loaded only afterwards; `withdrawn`: otherwise. Null and blank
    references are no case. A record without loaded_at exists but is never in order
    and counts as later than any time; a reference without loaded_at is judged after
    everything with a time and has a null month. Repeated rows are judged each.
    `compare` maps a column name to how its names are compared.

    Record starts, withdrawals and references become one timeline per name, summed
    by running_sums: a name that holds a third of all rows is spread over tasks.
    """
    end_of_time = F.lit(2**62)
    r = records.select(compare(name).alias("k"), micros(loaded_at).alias("t0"), micros(withdrawn_at).alias("t1")).where("k is not null")
    lives = F.col("t0").isNotNull() & (F.col("t1").isNull() | (F.col("t1") > F.col("t0")))
    none = [F.lit(None).cast("string").alias("tab"), F.lit(None).cast(row_type).alias("row_id"), F.lit(None).cast("string").alias("load_month")]
    starts = r.select("k", F.coalesce("t0", end_of_time + 1).alias("t"), F.lit(0).alias("kind"), F.when(lives, 1).otherwise(0).alias("up"), F.lit(1).alias("rec"), *none)
    ends = r.where(lives & F.col("t1").isNotNull()).select("k", F.col("t1").alias("t"), F.lit(0).alias("kind"), F.lit(-1).alias("up"), F.lit(0).alias("rec"), *none)
    probes = [
        x.df.select(compare(x.key).alias("k"), F.coalesce(micros(x.loaded_at), end_of_time).alias("t"), F.lit(1).alias("kind"), F.lit(0).alias("up"), F.lit(0).alias("rec"), F.lit(x.tab).alias("tab"), F.col(x.row_id).cast(row_type).alias("row_id"), month(x.loaded_at).alias("load_month")).where("k is not null")
        for x in refs
    ]
    events = reduce(DataFrame.unionByName, [starts, ends, *probes])
    line = running_sums(events, ["k"], ["t", "kind", "tab", "row_id"], {"up": F.col("up"), "rec": F.col("rec")}, parts)
    reason = F.when(F.col("rec_all") == 0, "missing").when(F.col("rec_all") > F.col("rec_run"), "late").otherwise("withdrawn")
    return line.where("kind = 1 and up_run <= 0").select(
        "tab",
        "load_month",
        "row_id",
        reason.alias("reason"),
    )


@dataclass(frozen=True)
class ForeignKey:
    """A reference; `also` names further (parent, column) pairs of which any may hold the row."""

    child: str
    column: str
    parent: str
    parent_column: str
    also: tuple[tuple[str, str], ...] = ()

    @property
    def parents(self) -> tuple[tuple[str, str], ...]:
        return ((self.parent, self.parent_column), *self.also)

    @property
    def label(self) -> str:
        return f"{self.child}.{self.column}->{'|'.join(p for p, _ in self.parents)}"


def orphan_cascade(tables: dict[str, DataFrame], keys: dict[str, str], fks: list[ForeignKey], compare=F.col, max_rounds: int = 1000, times: dict[str, tuple[str, str | None]] | None = None) -> DataFrame:
    """Direct and inherited orphans over a foreign-key graph, by fixpoint.

    tables: name -> rows; keys: name -> the column that names its rows. Result: tab,
    row_id (string), fk (the violated or inherited reference), kind (`direct` or
    `inherited`), depth (0 for direct). A row is a direct orphan if a non-null
    reference of it finds no parent row; it inherits if every parent row of a
    reference is an orphan. Each round semi-joins the children with the parent keys
    of which rows have become orphans, until a round finds no new row; cycles in
    the graph end too. Orphans of a round are written to the shared folder. A row is reported once per
    reference, in the first round in which that reference fails. Null references
    are no case; `compare` maps a column name to how its values are compared.

    times: name -> the columns of arrival and withdrawal (None: never). With it every
    reference is judged at the moment its row arrived, by references_at_load: only
    parent rows that had arrived and were not withdrawn then count, and the result
    also has load_month and reason (`missing`, `late`, `withdrawn`; null if inherited).
    The direct level is this judgement; the further ones pass it on. A graph that is still passing
    orphans on after max_rounds raises an error instead of stopping short.
    """

    def rows_of(n: str) -> DataFrame:
        wanted = sorted({f.column for f in fks if f.child == n} | {c for f in fks for p, c in f.parents if p == n})
        at = [F.lit(None).cast("timestamp_ntz").alias(a) if c is None else F.col(c).alias(a) for a, c in zip(("t0", "t1"), times[n], strict=True)] if times else []
        return tables[n].select(F.col(keys[n]).cast("string").alias("row_id"), *(compare(c).alias(f"c_{c}") for c in wanted), *at)

    key_of = {n: rows_of(n) for n in tables}
    at = ["t0", "t1"] if times else []
    found: list[DataFrame] = []
    fresh: dict[str, DataFrame] = {}
    gone: dict[str, DataFrame] = {}

    def parent_rows(ps: tuple[tuple[str, str], ...], alive: bool) -> DataFrame:
        out = []
        for p, c in ps:
            rows = key_of[p].where(F.col(f"c_{c}").isNotNull())
            if alive and p in gone:
                rows = rows.join(gone[p].select("row_id").distinct(), "row_id", "left_anti")
            out.append(rows.select(F.col(f"c_{c}").alias("pk"), *at))
        return reduce(DataFrame.unionByName, out)

    def failing(rows: DataFrame, children: list[tuple[ForeignKey, DataFrame]]) -> DataFrame:
        """label, row_id of the references that no parent row serves."""
        if times:
            refs = [References(f.label, child, "row_id", f"c_{f.column}", "t0") for f, child in children]
            return references_at_load(rows, "pk", "t0", "t1", refs, compare=F.col, row_type="string").withColumnRenamed("tab", "fk")
        parents = rows.select("pk").distinct()
        return reduce(DataFrame.unionByName, [child.join(parents, child[f"c_{f.column}"] == parents["pk"], "left_anti").select(F.lit(f.label).alias("fk"), "row_id") for f, child in children])

    for depth in range(max_rounds):
        by_parents: dict[tuple, list[ForeignKey]] = {}
        for f in fks:
            if depth == 0 or any(p in fresh for p, _ in f.parents):
                by_parents.setdefault(f.parents, []).append(f)
        now: dict[str, list[DataFrame]] = {}
        for ps, group in by_parents.items():
            rows, children = parent_rows(ps, depth > 0), []
            if depth:
                hurt = [key_of[p].join(fresh[p].select("row_id").distinct(), "row_id", "left_semi").select(F.col(f"c_{c}").alias("pk")) for p, c in ps if p in fresh]
                touched = stored(reduce(DataFrame.unionByName, hurt).where("pk is not null").distinct())
                rows = rows.join(touched, "pk", "left_semi")
            for f in group:
                child = key_of[f.child].where(F.col(f"c_{f.column}").isNotNull())
                if depth:
                    child = child.join(touched, child[f"c_{f.column}"] == touched["pk"], "left_semi")
                    if f.child in gone:
                        child = child.join(gone[f.child].where(F.col("fk") == f.label).select("row_id"), "row_id", "left_anti")
                children.append((f, child))
            hits = failing(rows, children)
            if depth and times:
                hits = hits.withColumn("reason", F.lit(None).cast("string"))
            if len({f.child for f in group}) > 1:
                hits = stored(hits)
            for n in {f.child for f in group}:
                now.setdefault(n, []).append(hits.where(F.col("fk").isin([f.label for f in group if f.child == n])))
        fresh = {}
        for n, hits in now.items():
            new = reduce(DataFrame.unionByName, hits).withColumns({"kind": F.lit("inherited" if depth else "direct"), "depth": F.lit(depth)})
            new = stored(new)
            if not new.isEmpty():
                fresh[n] = new
                gone[n] = gone[n].unionByName(new) if n in gone else new
                found.append(new.select(F.lit(n).alias("tab"), "row_id", "fk", "kind", "depth", *(["load_month", "reason"] if times else [])))
        if not fresh:
            break
    else:
        raise RuntimeError(f"orphans are still passed on after {max_rounds} rounds")
    if not found:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "tab string, row_id string, fk string, kind string, depth int" + ", load_month string, reason string" * bool(times))
    return reduce(DataFrame.unionByName, found)
