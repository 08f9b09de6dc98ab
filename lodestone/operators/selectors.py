"""Choices that depend on what was chosen before, made inside one query's candidates.

Each runs once per query over its candidate list, which retrieval has cut to a few hundred rows,
so a group is small by construction and goes to one Arrow-batched call.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _per_query(hits: DataFrame, choose, extra: list[tuple[str, T.DataType]]) -> DataFrame:
    schema = T.StructType([*hits.schema.fields, *(T.StructField(n, t) for n, t in extra)])
    return hits.groupBy("query_id").applyInPandas(choose, schema)


def without_near_duplicates(hits: DataFrame, limit: int, threshold: float = 0.84) -> DataFrame:
    """hits(query_id, node_id, parent_id, text, rank): greedily those unlike all chosen ones, then duplicates to fill up.

    Two hits are alike if they have one parent or a matching ratio of at least the threshold.
    Adds `chosen` (from 1) and `duplicate`.
    """

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        kept, repeats = [], []
        rows = group.sort_values(["rank", "node_id"])
        for row in rows.itertuples():
            def alike(other) -> bool:
                same_parent = row.parent_id is not None and row.parent_id == other.parent_id
                return same_parent or SequenceMatcher(None, row.text or "", other.text or "", autojunk=False).ratio() >= threshold

            (repeats if any(map(alike, kept)) else kept).append(row)
        order = [(r.Index, False) for r in kept][:limit]
        order += [(r.Index, True) for r in repeats][: limit - len(order)]
        out = rows.loc[[i for i, _ in order]].copy()
        out["chosen"] = range(1, len(out) + 1)
        out["duplicate"] = [d for _, d in order]
        return out

    return _per_query(hits, choose, [("chosen", T.LongType()), ("duplicate", T.BooleanType())])


def with_quota(hits: DataFrame, limit: int, least: int) -> DataFrame:
    """hits(query_id, node_id, rank, wanted): the first `limit`, the lowest unwanted ones replaced until `least` are wanted."""

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["rank", "node_id"])
        top, rest = rows.head(limit), rows.iloc[limit:]
        lacking = max(0, least - int(top["wanted"].sum()))
        spare = rest[rest["wanted"]].head(lacking)
        drop = top[~top["wanted"]].tail(len(spare)).index
        out = pd.concat([top.drop(drop), spare.head(len(drop))]).copy()
        out["chosen"] = range(1, len(out) + 1)
        return out

    return _per_query(hits, choose, [("chosen", T.LongType())])


def capped(hits: DataFrame, limit: int, source_cap: int, bucket_caps: dict[str, int]) -> DataFrame:
    """hits(query_id, node_id, rank, source, bucket): as the three-pass source limit, with caps on buckets in the first two passes."""

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        rows = list(group.sort_values(["rank", "node_id"]).itertuples())
        taken, of_source, of_bucket = [], {}, {}
        for most in (source_cap, max(source_cap, min(limit, 2 * source_cap)), None):
            for row in rows:
                if len(taken) >= limit:
                    break
                if row.Index in taken:
                    continue
                if most is not None and (of_source.get(row.source, 0) >= most or of_bucket.get(row.bucket, 0) >= bucket_caps.get(row.bucket, limit)):
                    continue
                taken.append(row.Index)
                of_source[row.source] = of_source.get(row.source, 0) + 1
                of_bucket[row.bucket] = of_bucket.get(row.bucket, 0) + 1
        out = group.loc[taken].copy()
        out["chosen"] = range(1, len(out) + 1)
        return out

    return _per_query(hits, choose, [("chosen", T.LongType())])


def context_by_budget(hits: DataFrame, limit: int, budget: int) -> DataFrame:
    """hits(query_id, node_id, rank, text, mandatory): mandatory ones that fit, then others until the first that doesn't; never none."""

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        rows = list(group.sort_values(["rank", "node_id"]).itertuples())
        taken, used = [], 0
        for row in rows:
            if row.mandatory and len(taken) < limit and used + len(row.text or "") <= budget:
                taken.append(row.Index)
                used += len(row.text or "")
        for row in rows:
            if row.Index in taken:
                continue
            if len(taken) >= limit or used + len(row.text or "") > budget:
                break
            taken.append(row.Index)
            used += len(row.text or "")
        out = group.loc[taken or [rows[0].Index]].copy()
        out["chosen"] = range(1, len(out) + 1)
        return out

    return _per_query(hits, choose, [("chosen", T.LongType())])


def citations(hits: DataFrame, limit: int = 6, quote: int = 280) -> DataFrame:
    """The first hits of each query with a quote and a level of trust by score (0.55, 0.35)."""
    level = F.when(F.col("score") >= 0.55, "high").when(F.col("score") >= 0.35, "medium").otherwise("low")
    return hits.filter(F.col("rank") <= limit).select("query_id", "node_id", "rank", F.left("text", F.lit(quote)).alias("quote"), level.alias("level"))


def verbatim(quote: Column, excerpt: Column) -> Column:
    """The quote as it stands in the excerpt, or in the excerpt with its line ends unified; null if it doesn't."""
    bare, unified = F.trim(quote), F.regexp_replace(excerpt, "\r\n", "\n")
    plain = F.regexp_replace(bare, "\r\n", "\n")
    return F.when(F.length(bare) == 0, None).when(excerpt.contains(bare), bare).when(unified.contains(plain), plain)


def confidence(n_citations: Column, has_facts: Column) -> Column:
    return F.least(F.lit(0.95), 0.35 + 0.08 * n_citations + 0.06 * has_facts.cast("int"))
