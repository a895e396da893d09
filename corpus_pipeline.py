"""A corpus pipeline of five stages over documents. Counted as part of the package's llm folder.

Each stage takes a table with doc_id, text and source and any other columns, whatever their names; all but the last
return the columns they got. Null ids, null texts, empty texts and repeated rows have results that each stage states. An empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudform.llm import bpe, mixing, ngram_join, suffix_dedup, toxicity
from cloudform.llm._base import BITS, Scratch, fresh, sieved, small_batches, with_value

TOKENIZER = "byte_bpe_50k.json"


def ordered(kind: T.DataType) -> bool:
    """Whether Spark can sort values of a type; maps and variants it can't, nor what holds them."""
    if isinstance(kind, T.StructType):
        return all(ordered(f.dataType) for f in kind.fields)
    return ordered(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def one_each(docs: DataFrame, keys: list[F.Column]) -> DataFrame:
    """The smallest row, column by column, of each key; columns that have no order come last, as JSON."""
    names = [fresh(f"k{i}", docs.columns) for i in range(len(keys))]
    row = fresh("row", docs.columns)
    own = {f.name: ordered(f.dataType) for f in docs.schema.fields}
    rank = [F.col(f"`{c}`") for c in own if own[c]] + [F.to_json(F.struct(F.col(f"`{c}`"))) for c in own if not own[c]]
    least = F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct(*rank))
    out = docs.groupBy(*(k.alias(n) for k, n in zip(keys, names, strict=True))).agg(least.alias(row))
    return out.select(*(F.col(row).getField(c).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below 0.5. Null and empty texts score like texts without evidence.

    Rows that repeat an id are judged one by one, by their texts. No text is shuffled to be judged: the verdicts travel.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(toxicity.fold("doc_id") != 0)
    tables = toxicity.fit_toxicity(docs.select("doc_id", "text"), labels)
    scores = toxicity.toxicity_scores(docs.select(F.col("doc_id").alias("k0"), F.xxhash64("text").alias("k1"), "text"), tables, own=True)
    known = Scratch(spark).put(scores.groupBy("k0", "k1").agg(F.max((F.col("score") >= 0.5).cast("int")).alias("v")), "scores")
    toxic = fresh("toxic", docs.columns)
    rows = with_value(docs, [F.col("doc_id"), F.xxhash64("text")], known, toxic)
    return rows.where(F.col(toxic) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def without(docs: DataFrame, gone: DataFrame, bits: int = BITS) -> DataFrame:
    """docs without the ids of gone, by an exact join that only documents enter whose bit is set in a bitmap of gone.

    Rows without an id stay.
    """
    may, no = sieved(docs, F.xxhash64("doc_id"), gone, F.xxhash64("doc_id"), bits)
    return no.unionByName(may.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies; of rows that repeat an id, the smallest.

    Rows without an id stay, as do texts without words.
    """
    s = Scratch(spark)
    found = ngram_join.ngram_jaccard_join(docs.select("doc_id", "text")).where("doc_id is not null")
    ids = s.put(found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"), (F.count("*") > 1).alias("often")), "ids")
    out = without(docs.where("doc_id is not null"), ids.where("not stays").select("doc_id"))
    often = ids.where("stays and often").select("doc_id")
    if often.limit(1).count():
        may, no = sieved(out, F.xxhash64("doc_id"), often, F.xxhash64("doc_id"))
        out = no.unionByName(one_each(may, [F.col("doc_id")]))
    return out.unionByName(docs.where("doc_id is null"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its repeated 200-byte strings; bytes that are no longer whole characters become U+FFFD.

    A null text becomes empty. Rows that repeat an id are texts of their own. n_chars, where there is such a column,
    is counted again.
    """
    small_batches(spark, 1 << 22)  # whole texts, suffixes and their joins stand beside each other here
    rows = suffix_dedup.suffix_dedup(docs)
    text = F.expr("make_valid_utf8(cast(kept as string))")
    made = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text)}
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    return rows.select(*((made[c].cast(kinds[c]) if c in made else F.col("rest").getField(c)).alias(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it.

    Of rows that repeat id, text and source, null ids included, the smallest stands for all, with their copies. Texts
    without words have no words to take: they come as often as a whole copy of each document of their source does.
    """
    s = Scratch(spark)
    found = mixing.mix_sources(docs.select("doc_id", "text", "source"))
    known = found.groupBy(F.col("doc_id").alias("k0"), F.col("twin").alias("k1"), F.col("source").alias("k2")).agg(F.sum("copies").alias("v"), F.count("*").alias("rows"))
    known = s.put(known, "copies")
    keys = [F.col("doc_id").cast("long"), F.xxhash64("text"), F.col("source").cast("string")]
    own, times = [F.col(f"`{c}`") for c in docs.columns], fresh("times", docs.columns)
    once = with_value(docs, keys, known.select("k0", "k1", "k2", F.when(F.col("rows") == 1, F.col("v")).otherwise(0).cast("int").alias("v")), times)
    out = once.where(F.col(times) > 0).select(*own, F.explode(F.array_repeat(F.lit(0), F.col(times))).alias(fresh("copy", docs.columns))).select(*own)
    often = known.where("rows > 1").drop("rows")
    if often.limit(1).count():
        may, _ = sieved(docs, F.xxhash64(*keys), often, F.xxhash64("k0", "k1", "k2"))
        names = [fresh(c, docs.columns) for c in often.columns]
        on = [a.eqNullSafe(F.col(b)) for a, b in zip(keys, names, strict=False)]
        more = one_each(may, keys).join(often.toDF(*names), on)
        out = out.unionByName(more.select(*own, F.explode(F.expr(f"array_repeat(0, cast(`{names[-1]}` as int))")).alias(fresh("copy", docs.columns))).select(*own))
    return out


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and digests of the ids and of the decoded text.

    A null text is empty. Each row is encoded by itself; other columns are left away.
    """
    import public_tokenizers

    path = public_tokenizers.path(TOKENIZER)
    rows = bpe.bpe_decode(bpe.bpe_encode(docs, path=path), path=path)
    return rows.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("suffix_dedup", drop_repeats), ("mix_sources", mix), ("bpe", tokenize)]

# The classifier and the mix's draws are no SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.put(docs, f"{k}_{name}")
    return docs
