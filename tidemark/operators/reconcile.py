"""Reconciliation of attempted, accepted, ambiguous and stored IDs, by set and by content."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.json_udfs import canonical_json
from tidemark.operators.ordered import join_nullsafe
from tidemark.operators.store import first_wins

SETS = ("attempted", "accepted", "ambiguous", "stored")


def id_flags(sets: DataFrame, run: str = "run_id") -> DataFrame:
    """One row per (run, id): membership in each set and the number of stored rows.

    One grouping replaces a join per rule; copies of an ID combine before the shuffle.
    """
    has = {s: F.max(F.col("set_name") == s) for s in SETS[:3]}
    return sets.groupBy(run, "event_id").agg(
        *[c.alias(s) for s, c in has.items()], F.count_if(F.col("set_name") == "stored").alias("stored_rows")
    ).withColumn("stored", F.col("stored_rows") > 0)


def is_missing() -> Column:
    return F.col("accepted") & ~F.col("stored")


def is_unexpected() -> Column:
    return F.col("stored") & ~F.col("attempted") & ~F.col("accepted")


def reconcile(sets: DataFrame, run: str = "run_id") -> DataFrame:
    """Counts per run. An ambiguous ID that is not stored is unknown, not lost."""
    g = id_flags(sets, run).groupBy(run).agg(
        *[F.count_if(F.col(s)).alias(s) for s in SETS],
        F.count_if(is_missing()).alias("missing"),
        F.count_if(is_unexpected()).alias("unexpected"),
        (F.sum("stored_rows") - F.count_if("stored")).alias("duplicates"),
        F.count_if(F.col("ambiguous") & F.col("stored")).alias("ambiguous_persisted"),
        F.count_if(F.col("ambiguous") & ~F.col("stored")).alias("ambiguous_unobserved"),
    )
    return g.withColumn("correct", (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("duplicates") == 0))


def set_sizes(sets: DataFrame, run: str = "run_id") -> DataFrame:
    """Distinct IDs and repeated rows of each set."""
    ids = sets.groupBy(run, "set_name", "event_id").agg(F.count(F.lit(1)).alias("c"))
    return ids.groupBy(run, "set_name").agg(
        F.count(F.lit(1)).alias("ids"), (F.sum("c") - F.count(F.lit(1))).alias("duplicates")
    )


def flat_digest(ids: DataFrame, by: Sequence[str]) -> DataFrame:
    """SHA-256 of the members ``m`` of each set, sorted and joined by newlines; a set's members stream through one task."""
    by = list(by)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, digest = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            starts = (pdf[by] != pdf[by].shift()).any(axis=1).to_numpy().nonzero()[0]
            for low, high in zip(starts, [*starts[1:], len(pdf)], strict=True):
                key = tuple(pdf[by].iloc[low])
                text = "\n".join(pdf["m"].iloc[low:high])
                if digest is not None and key == at:
                    digest.update(b"\n" + text.encode())
                    continue
                if digest is not None:
                    yield pd.DataFrame([[*at, digest.hexdigest()]], columns=[*by, "sha256"])
                at, digest = key, hashlib.sha256(text.encode())
        if digest is not None:
            yield pd.DataFrame([[*at, digest.hexdigest()]], columns=[*by, "sha256"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in ids.select(*by).dtypes), "sha256 string"])
    return ids.where("m IS NOT NULL").repartition(*by).sortWithinPartitions(*by, "m").select(*by, "m").mapInPandas(fold, schema)


WIDE_SET = 1 << 26  # members of a set from which leaves are told by eight digits instead of four


def hash_tree(rows: DataFrame, by: Sequence[str], hashed: str | Column, text: str, copies: str | None = None, join: Callable[[Column], Column] | None = None, wide: int = WIDE_SET, counted: DataFrame | None = None) -> DataFrame:
    """(by, members, root): one digest for each set, from groups whose size is bounded whatever the set's.

    Members fall into 65,536 leaves by the first four digits of ``hashed``, a column or better an expression over ``text``, those of a set of over ``wide``
    rows into 2^32 by eight. A leaf is the digest of its sorted ``text``; eight-digit leaves are digested by their first four digits, and then the
    sorted list of what is left. ``join`` makes a list one text. A set's digest depends on its members only. ``counted`` are rows that are cheaper
    to count and at least as many in each set: members are then counted only where these are over ``wide``.
    """
    by, n = list(by), F.sum(F.col(copies)) if copies else F.count(F.lit(1))
    join = join or (lambda a: F.array_join(a, "\n"))
    digest = lambda c: F.sha2(join(F.array_sort(F.collect_list(c))), 256)
    over = lambda df: df.groupBy(*by).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > wide).select(*by)
    may_be = rows if counted is None else join_nullsafe(rows, F.broadcast(over(counted)), by, "left_semi")
    large = over(may_be).withColumn("__wide", F.lit(True))
    # members go to their node's task once, without its name; leaves and nodes are then digested where they lie, and only nodes move on
    node, carried = F.substring(hashed, 1, 4), dict.fromkeys([text, *([copies] if copies else []), *([hashed] if isinstance(hashed, str) else [])])
    dealt = rows.select(*by, *carried).repartition(*by, node)
    told = join_nullsafe(dealt, F.broadcast(large), by, "left")  # at most one set for each ``wide`` rows; a shuffle would move all members, by set
    placed = told.withColumns({"node": node, "leaf": F.when(F.col("__wide"), F.substring(hashed, 1, 8)).otherwise(node)})
    leaves = placed.groupBy(*by, "node", "leaf").agg(n.alias("c"), digest(F.col(text)).alias("d"))
    entry = F.concat("leaf", F.lit(":"), "d")
    nodes = leaves.groupBy(*by, "node").agg(
        F.sum("c").alias("c"), F.when(F.max(F.length("leaf")) > 4, digest(entry)).otherwise(F.max("d")).alias("d")
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("node", F.unhex("d").alias("d")))), lambda x: F.concat(x["node"], F.lit(":"), F.lower(F.hex(x["d"]))))
    return nodes.groupBy(*by).agg(F.sum("c").alias("members"), F.sha2(join(listed), 256).alias("root"))


def tree_digest(sets: DataFrame, by: Sequence[str] = ("run_id", "set_name"), member: str = "event_id", wide: int = WIDE_SET) -> DataFrame:
    """(by, ids, tree_sha256) of the distinct members of each set, in parallel."""
    by = list(by)
    ids = sets.select(*by, F.col(member).cast("string").alias("m")).distinct().where("m IS NOT NULL")
    return hash_tree(ids, by, F.sha2("m", 256), "m", wide=wide, counted=sets).withColumnsRenamed({"members": "ids", "root": "tree_sha256"})


def set_digest(sets: DataFrame, by: Sequence[str] = ("run_id", "set_name"), member: str = "event_id") -> DataFrame:
    """Digests of the distinct members of each set.

    ``sha256`` is the SHA-256 of the sorted members joined by newlines: one ordered pass over each set, in constant memory, which can't be made in
    parallel. ``tree_sha256`` has no such pass; compare sets by it where you can.
    """
    by = list(by)
    ids = sets.select(*by, F.col(member).cast("string").alias("m")).distinct()
    return tree_digest(sets, by, member).join(flat_digest(ids, by), by, "left").select(*by, "ids", "sha256", "tree_sha256")


def set_rules(sets: DataFrame, run: str = "run_id") -> DataFrame:
    """Subset and disjointness rules as rows: (run, rule, passed, violations)."""
    f = id_flags(sets, run)
    rules = {
        "accepted_in_attempted": F.col("accepted") & ~F.col("attempted"),
        "ambiguous_in_attempted": F.col("ambiguous") & ~F.col("attempted"),
        "accepted_in_stored": F.col("accepted") & ~F.col("stored"),
        "stored_in_attempted": F.col("stored") & ~F.col("attempted"),
        "accepted_ambiguous_disjoint": F.col("accepted") & F.col("ambiguous"),
    }
    wide = f.groupBy(run).agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    pairs = ", ".join(f"'{n}', {n}" for n in rules)
    long = wide.selectExpr(run, f"stack({len(rules)}, {pairs}) AS (rule, violations)")
    return long.select(run, "rule", (F.col("violations") == 0).alias("passed"), "violations")


def exact_set(expected: DataFrame, actual: DataFrame, by: Sequence[str], member: str) -> DataFrame:
    """Whether each group's actual members are the expected ones, each once."""
    tagged = expected.select(*by, member, F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(
        actual.select(*by, member, F.lit(0).alias("e"), F.lit(1).alias("a"))
    )
    ids = tagged.groupBy(*by, member).agg(F.max("e").alias("e"), F.sum("a").alias("a"))
    return ids.groupBy(*by).agg(
        F.count_if((F.col("e") == 1) & (F.col("a") == 0)).alias("missing"),
        F.count_if(F.col("e") == 0).alias("unexpected"),
        F.count_if(F.col("a") > 1).alias("repeated"),
    ).withColumn("equal", F.col("missing") + F.col("unexpected") + F.col("repeated") == 0)


def case_population(stored: DataFrame, tenant: str, event_type: str, ids: DataFrame) -> DataFrame:
    """Rows of a case: the tenant's rows of its type or with one of its IDs, each once."""
    wanted = ids.select("event_id").distinct().withColumn("__wanted", F.lit(True))
    mine = stored.where(F.col("tenant_id") == tenant)
    return mine.join(wanted, "event_id", "left").where((F.col("event_type") == event_type) | F.col("__wanted")).drop("__wanted")


def prefix_population(stored: DataFrame, tenant: str, path: str, prefix: str, ids: DataFrame) -> DataFrame:
    """Rows of a tenant whose payload field starts with a prefix, or with one of the IDs."""
    wanted = ids.select("event_id").distinct().withColumn("__wanted", F.lit(True))
    field = F.get_json_object("payload", path)
    mine = stored.where(F.col("tenant_id") == tenant)
    return mine.join(wanted, "event_id", "left").where(field.startswith(prefix) | F.col("__wanted")).drop("__wanted")


def verify_content(
    stored: DataFrame,
    expected: DataFrame,
    required: DataFrame,
    keys: Sequence[str] = ("event_id",),
    position: str = "position",
    instants: Sequence[str] = ("occurred_at",),
    repeats: bool = False,
) -> DataFrame:
    """Findings (keys, finding, rows): missing, unexpected, mismatch and, if asked, repeated.

    Content is the type, the instants and the payload as a JSON value. Unexpected
    rows are not compared. A number outside float64 is a mismatch even when both
    texts agree. Equal stored rows combine before the shuffle.
    """
    keys = list(keys)
    cols = ["event_type", *instants]
    want = first_wins(expected, keys, [position]).select(
        *keys, *[F.col(c).alias(f"w_{c}") for c in cols], canonical_json("payload").alias("w_payload"), F.lit(True).alias("known")
    )
    have = stored.groupBy(*keys, *cols, "payload").agg(F.count(F.lit(1)).alias("rows"))
    j = have.withColumn("json", canonical_json("payload")).join(want, keys, "left")
    same = F.coalesce(F.col("json") == F.col("w_payload"), F.lit(False))
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"w_{c}"))
    finding = F.when(F.col("known").isNull(), "unexpected").when(~same, "mismatch")
    rows = j.select(*keys, finding.alias("finding"), "rows").where("finding IS NOT NULL")
    rows = rows.groupBy(*keys, "finding").agg(F.sum("rows").alias("rows"))
    absent = required.select(*keys).distinct().join(stored.select(*keys), keys, "left_anti")
    out = rows.unionByName(absent.select(*keys, F.lit("missing").alias("finding"), F.lit(1).cast("bigint").alias("rows")))
    if repeats:
        again = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
        out = out.unionByName(again.select(*keys, F.lit("repeated").alias("finding"), (F.col("rows") - 1).alias("rows")))
    return out


def strict_table_check(stored: DataFrame, expected: DataFrame, keys: Sequence[str], position: str = "position") -> DataFrame:
    """Every stored row expected once, none missing, and the receipt time compared too."""
    return verify_content(stored, expected, expected, keys, position, ("occurred_at", "received_at"), repeats=True)


def observe_pending(pending: DataFrame, stored: DataFrame, keys: Sequence[str] = ("event_id",)) -> tuple[DataFrame, DataFrame]:
    """(observed, still pending). Visibility is decided by the stored row alone, never by its time."""
    keys = list(keys)
    waiting = pending.select(*keys).distinct()
    return waiting.join(stored.select(*keys, "received_at"), keys), waiting.join(stored.select(*keys), keys, "left_anti")
