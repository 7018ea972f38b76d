"""Vector compression: 8- and 16-bit quantization, delta against reference vectors, the pool of shared vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.vectors import cosine, vector_hash
from notelake.operators.references import best_references, counted
from notelake.session import drop_scratch, scratch, written

#: Bytes that a quantized vector carries beside its codes (minimum, scale, dimension).
OVERHEAD = 16


def parameters(vector: Column, bits: int) -> tuple[Column, Column]:
    """(minimum, scale): scale is the range over 2^bits - 1, and 1 for a constant vector."""
    low, high = F.array_min(vector).cast("double"), F.array_max(vector).cast("double")
    return low, F.when(high > low, (high - low) / F.lit(float(2**bits - 1))).otherwise(F.lit(1.0))


def quantize(vector: Column, low: Column, scale: Column, bits: int) -> Column:
    """Codes: round half away from zero of (x - minimum) / scale, at most 2^bits - 1."""
    return F.transform(vector, lambda x: F.least(F.round((x.cast("double") - low) / scale), F.lit(float(2**bits - 1))).cast("int"))


def dequantize(codes: Column, low: Column, scale: Column) -> Column:
    return F.transform(codes, lambda q: low + q * scale)


def quantized(rows: DataFrame, vector: str, bits: int) -> DataFrame:
    """Adds ``codes``, ``low``, ``scale``. Null and empty vectors have null parameters and no codes."""
    low, scale = parameters(F.col(vector), bits)
    return rows.withColumn("low", low).withColumn("scale", F.when(F.col("low").isNotNull(), scale)).withColumn("codes", quantize(F.col(vector), F.col("low"), F.col("scale"), bits))


def roundtrip_error(rows: DataFrame, vector: str, bits: int) -> DataFrame:
    """Adds the greatest error of decoding, and whether it is within half a step (but for rounding)."""
    q = quantized(rows, vector, bits).withColumn("back", dequantize(F.col("codes"), F.col("low"), F.col("scale")))
    worst = F.array_max(F.zip_with(vector, "back", lambda a, b: F.abs(a.cast("double") - b)))
    return q.withColumn("max_error", worst).withColumn("within", F.col("max_error") <= F.col("scale") * 0.51)


def ratios(rows: DataFrame, vector: str) -> DataFrame:
    """Bytes before and after 8- and 16-bit quantization."""
    n = F.size(vector)
    sums = rows.where(n > 0).agg(F.count(F.lit(1)).alias("vectors"), F.sum(n * 4).alias("original_bytes"), F.sum(n + OVERHEAD).alias("bytes_8bit"), F.sum(n * 2 + OVERHEAD).alias("bytes_16bit"))
    return sums.withColumn("ratio_8bit", F.round(F.col("bytes_8bit") / F.col("original_bytes"), 6)).withColumn("ratio_16bit", F.round(F.col("bytes_16bit") / F.col("original_bytes"), 6))


def delta_encoded(rows: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(id, reference, codes, low, scale): 8-bit delta to the most similar reference vector with cosine at or above the threshold, else 8-bit of itself.

    References are the seeds of greedy clusters in id order, so a vector that becomes a reference has none itself, and
    the order of arrival doesn't matter. Equal vectors share the reference of the one with the least id, or refer to that one. A delta is taken to the
    reference as it is decoded, so its error is within half a step. ``reference`` is null for self-coded vectors.
    """
    hashed = rows.where("id is not null").select("id", vector_hash(F.col("vector")).alias("h"))
    firsts = hashed.where("h is not null").groupBy("h").agg(F.min("id").alias("first"))
    distinct = written(rows.join(firsts.select(F.col("first").alias("id")), "id", "left_semi").select("id", "vector"), "distinct")
    found = written(best_references(distinct, threshold).select("id", "reference"), "references")
    usable = cosine(F.col("vector"), F.col("vector")).isNotNull()
    twins = hashed.join(firsts, "h").where("id <> first").join(rows.where(usable).select("id"), "id", "left_semi").join(found.withColumnRenamed("id", "first"), "first", "left").select("id", F.coalesce("reference", "first").alias("reference"))
    base = rows.join(found.unionByName(twins), "id", "left")
    own = quantized(base.where("reference is null").select("id", "vector"), "vector", 8)
    refs = own.select(F.col("id").alias("reference"), dequantize(F.col("codes"), F.col("low"), F.col("scale")).alias("ref_vector"))
    both = base.join(refs, "reference", "left")
    delta = F.when(F.col("ref_vector").isNotNull(), F.zip_with("vector", "ref_vector", lambda a, b: a.cast("double") - b.cast("double"))).otherwise(F.transform("vector", lambda a: a.cast("double")))
    return quantized(both.withColumn("delta", delta), "delta", 8).select("id", "reference", "codes", "low", "scale")


def delta_decoded(encoded: DataFrame) -> DataFrame:
    """Adds ``decoded``: references by themselves, others as reference plus delta."""
    plain = encoded.withColumn("own", dequantize(F.col("codes"), F.col("low"), F.col("scale")))
    refs = plain.where("reference is null").select(F.col("id").alias("reference"), F.col("own").alias("ref_own"))
    both = plain.join(refs, "reference", "left")
    return both.withColumn("decoded", F.when(F.col("ref_own").isNotNull(), F.zip_with("own", "ref_own", lambda a, b: a + b)).otherwise(F.col("own"))).drop("own", "ref_own")


def pool(rows: DataFrame) -> DataFrame:
    """(vector_hash, vector, uses): each distinct vector once."""
    return rows.groupBy(vector_hash(F.col("vector")).alias("vector_hash")).agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("uses"))


def pooled(rows: DataFrame) -> DataFrame:
    """Rows with the hash of their vector in place of the vector."""
    return rows.withColumn("vector_hash", vector_hash(F.col("vector"))).drop("vector")


def unpooled(rows: DataFrame, shared: DataFrame) -> DataFrame:
    return rows.join(shared.select("vector_hash", "vector"), "vector_hash", "left").drop("vector_hash")


def pool_encoded(rows: DataFrame, threshold: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(rows with ``vector_hash`` in place of the vector, pool): the combined encoding of a batch.

    Identical vectors are one row of the pool. Of these, those similar to a reference are a delta to it, if it spans no more than the vector itself (lengths may differ), the
    others are kept raw: pool (vector_hash, kind, reference, raw, codes, low, scale), kind being raw or delta; a delta's reference is raw. Null vectors have a null hash and no row.
    """
    paths = {x: scratch(rows.sparkSession, x) for x in ("pool", "references", "ids", "near", "deltas")}
    kept = lambda df, what: written(df, what, paths[what], free=True)
    stored = kept(pool(rows.where("vector is not null")).select(F.col("vector_hash").alias("id"), "vector"), "pool")
    refs = kept(best_references(stored, threshold).select("id", "reference"), "references")
    ids = kept(refs.select("id").unionByName(refs.select(F.col("reference").alias("id")).distinct()), "ids")
    near = kept(stored.join(counted(ids), "id", "left_semi"), "near")
    both = near.join(counted(refs), "id").join(near.select(F.col("id").alias("reference"), F.col("vector").alias("_base")), "reference")
    spread = lambda c: F.array_max(c) - F.array_min(c)
    delta = both.withColumn("_delta", F.zip_with("vector", "_base", lambda a, b: a.cast("double") - b.cast("double"))).where(spread(F.col("_delta")) <= spread(F.col("vector")))
    deltas = kept(quantized(delta, "_delta", 8).select("id", "reference", "codes", "low", "scale"), "deltas")
    raw = stored.join(counted(deltas.select("id")), "id", "left_anti").select(F.col("id").alias("vector_hash"), F.lit("raw").alias("kind"), F.col("vector").alias("raw"))
    coded = deltas.select(F.col("id").alias("vector_hash"), F.lit("delta").alias("kind"), "reference", "codes", "low", "scale")
    shared = raw.unionByName(coded, allowMissingColumns=True).select("vector_hash", "kind", "reference", "raw", "codes", "low", "scale")
    out = written(shared, "shared", free=True)
    drop_scratch(*paths.values())
    return pooled(rows), out


def pool_decoded(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows with their vectors again (double): raw ones as they were, deltas within half a step."""
    raw = shared.where("kind = 'raw'").select("vector_hash", F.col("raw").alias("_base"))
    back = dequantize(F.col("codes"), F.col("low"), F.col("scale"))
    deltas = shared.where("kind = 'delta'").select(F.col("vector_hash").alias("_id"), F.col("reference").alias("vector_hash"), "codes", "low", "scale")
    moved = deltas.join(raw, "vector_hash").select(F.col("_id").alias("vector_hash"), F.zip_with("_base", back, lambda a, b: a + b).alias("_moved"))
    vector = F.coalesce(F.transform("_base", lambda x: x.cast("double")), F.col("_moved"))
    return rows.join(raw, "vector_hash", "left").join(moved, "vector_hash", "left").withColumn("vector", vector).drop("vector_hash", "_base", "_moved")


def pool_statistics(rows: DataFrame) -> DataFrame:
    g = rows.groupBy(vector_hash(F.col("vector")).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d"))
    return g.agg(F.sum("n").alias("vectors"), F.count(F.lit(1)).alias("pooled"), (F.sum("n") - F.count(F.lit(1))).alias("shared"), F.sum(4 * F.col("d") * (F.col("n") - 1)).alias("saved_bytes"))
