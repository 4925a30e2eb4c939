"""Mixing sources to target weights by hash-threshold histograms.

Every record has a 36-bit hash. Tokens are summed by source and hash bucket; a
source's budget ends in one bucket, which alone is refined by the next 12 bits,
and again, until single hash values remain. The filter is then hash < cutoff:
nothing is sorted, and the budgets of smaller tiers give subsets of larger ones.

A source's budget is total * share * weight / (sum of weights of the sources
present), in whole tokens; a source that has less keeps all it has.

Defined cases: a null source is a source of its own; a null or empty text has no
tokens, and is kept where its hash falls below the cutoff; records of one key
share a hash and stay or go together; an empty table gives an empty result; input
columns named tier are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenscribe.llm.common import col, hex_hash, put, small
from lumenscribe.session import cut

LEVELS, STEP = 3, 12
#: Production targets: web-like src0 counts double; at most 60 % of all tokens are kept.
WEIGHTS, DEFAULT_WEIGHT, SHARE_PCT, TIERS_PCT = {"src0": 2}, 1, 60, (25, 50, 100)
TOKEN_RE = r"[^ \t\n\r\f]+"


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_RE)), F.lit(0)).cast("bigint")


def hash_of(key: Column) -> Column:
    return hex_hash(key, LEVELS * STEP // 4)


def weighed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """source, h, tokens (and the key) of each record, written once: all passes read this narrow table."""
    return cut(docs.select(col(key).alias("key"), col(source).cast("string").alias("source"), hash_of(col(key)).alias("h"), tokens_of(col(text)).alias("tokens")))


def cutoffs(rows: DataFrame, weights: dict[str, int] = WEIGHTS, default: int = DEFAULT_WEIGHT, share_pct: int = SHARE_PCT, tiers_pct: tuple[int, ...] = TIERS_PCT) -> DataFrame:
    """source, tier (1 the smallest), cutoff: records with a hash below the cutoff are in the tier."""
    weight = F.lit(default)
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, F.lit(w)).otherwise(weight)
    shift = LEVELS * STEP - STEP
    first = cut(rows.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("tokens").alias("tokens")))
    each = first.groupBy("source").agg(F.sum("tokens").alias("has")).withColumn("w", weight)
    whole = each.agg(F.sum("has").alias("all"), F.sum("w").alias("ws"))
    each = each.crossJoin(F.broadcast(whole)).select("source", F.expr(f"(`all` * {share_pct} div 100) * w div ws").alias("quota"))
    tiers = F.explode(F.array(*[F.struct(F.lit(k).alias("tier"), F.lit(p).alias("pct")) for k, p in enumerate(sorted(tiers_pct), 1)]))
    goals = cut(each.select("source", "quota", tiers.alias("t")).select("source", "t.tier", F.expr("quota * t.pct div 100").alias("left"), F.lit(0).cast("bigint").alias("prefix")))
    done, sums = [], first
    for level in range(LEVELS):
        inside = F.lit(True) if not level else F.shiftright(F.col("b.bucket"), STEP) == F.col("g.prefix")
        same = F.col("b.source").eqNullSafe(F.col("g.source")) & inside
        order = Window.partitionBy("g.source", "tier").orderBy("bucket")
        upto = sums.alias("b").join(small(goals).alias("g"), same).select("g.source", "tier", "bucket", "tokens", "left", F.sum("tokens").over(order).alias("upto"))
        over = upto.where("upto > left").groupBy("source", "tier").agg(F.min_by(F.struct("bucket", F.expr("left - (upto - tokens)").alias("left")), "bucket").alias("x"))
        found = cut(over.select("source", "tier", F.col("x.left").alias("left"), F.col("x.bucket").alias("prefix")))
        if not level:  # the budget holds the whole source
            g = goals.alias("g").join(found.alias("f"), F.col("g.source").eqNullSafe(F.col("f.source")) & (F.col("g.tier") == F.col("f.tier")), "left_anti")
            done.append(g.select("source", "tier", F.lit(1 << (LEVELS * STEP)).cast("bigint").alias("cutoff")))
        goals = found
        if level < LEVELS - 1:
            edge = small(goals.select(F.col("source").alias("s"), F.col("prefix").alias("p")).distinct())
            part = rows.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift) == F.col("p")))
            shift -= STEP
            sums = cut(part.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("tokens").alias("tokens")))
    done.append(goals.select("source", "tier", F.col("prefix").alias("cutoff")))
    return cut(done[0].unionByName(done[1]).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("tier", "cutoff"))).alias("ends")))


def select_tiers(rows: DataFrame, ends: DataFrame, source: Column, h: Column) -> DataFrame:
    """rows within the largest tier, with the smallest tier each is in."""
    pick = ends.select(F.col("source").alias("__source"), F.col("ends").alias("__ends"))
    joined = rows.join(small(pick), source.eqNullSafe(F.col("__source")))
    tier = F.filter("__ends", lambda e: h < e["cutoff"])[0]["tier"]
    inside = F.exists("__ends", lambda e: h < e["cutoff"])
    return put(joined.where(inside), tier=tier).drop("__source", "__ends")


def mix_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", **targets) -> DataFrame:
    """The documents of the mix, unchanged."""
    ends = cutoffs(weighed(docs, key, source), **targets)
    pick = ends.select(F.col("source").alias("__source"), F.array_max(F.transform("ends", lambda e: e["cutoff"])).alias("__cutoff"))
    joined = docs.join(small(pick), col(source).cast("string").eqNullSafe(F.col("__source")))
    return joined.where(hash_of(col(key)) < F.col("__cutoff")).select(*[col(c) for c in docs.columns])


_WEIGHT = "case source " + " ".join(f"when '{k}' then {v}" for k, v in WEIGHTS.items()) + f" else {DEFAULT_WEIGHT} end"
SQL = f"""
with docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{TOKEN_RE}'))::bigint as tokens,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 9))::bigint as h
  from documents),
quotas as (
  select source, ((sum(sum(tokens)) over ())::bigint * {SHARE_PCT} // 100) * ({_WEIGHT}) // (sum({_WEIGHT}) over ())::bigint as quota
  from docs group by source),
summed as (
  select *, sum(tokens) over (partition by source order by h range between unbounded preceding and current row) as upto from docs),
tiered as (
  select doc_id, s.source, tokens,
         case {" ".join(f"when upto <= quota * {p} // 100 then {k}" for k, p in enumerate(TIERS_PCT, 1))} end as tier
  from summed s join quotas q on q.source is not distinct from s.source)
select doc_id, source, tokens, tier::int as tier from tiered where tier is not null
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mix with their tokens and nested tier."""
    rows = weighed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    picked = select_tiers(rows, cutoffs(rows), F.col("source"), F.col("h"))
    return picked.select(F.col("key").alias("doc_id"), "source", "tokens", "tier")
