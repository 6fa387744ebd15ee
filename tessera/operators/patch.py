"""Arithmetic of activation edits on token rows (example_key, token_pos, values), and comparison of their results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import add, condition, dot, doubles, minus, norm, scale


def _lit(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def project_out(values: Column, components: Sequence[Sequence[float]], strength: float = 1.0) -> Column:
    """Values less strength times their part along orthonormal components."""
    out = values
    for c in components:
        out = minus(out, scale(_lit(c), dot(values, _lit(c)) * strength))
    return out


def add_direction(values: Column, raw: Column, strength: float = 1.0) -> Column:
    return add(values, scale(raw, strength))


def swap_mean(values: Column, donor_mean: Column, mean: Column, strength: float = 1.0) -> Column:
    """Values moved by strength times the donor's mean less the own one."""
    return add(values, scale(minus(donor_mean, mean), strength))


def swap_components(values: Column, donor: Column, own: Column, components: Sequence[Sequence[float]], strength: float = 1.0) -> Column:
    """Values moved along the components by the difference of the donor's coordinates and the own ones."""
    out = values
    for c in components:
        out = add(out, scale(_lit(c), (dot(donor, _lit(c)) - dot(own, _lit(c))) * strength))
    return out


def _rows(components: Sequence[Sequence[float]], z: Column) -> Column:
    """The part of z along orthonormal components."""
    out = F.transform(z, lambda x: x * 0.0)
    for c in components:
        out = add(out, scale(_lit(c), dot(z, _lit(c))))
    return out


def standardized(values: Column, mean: Sequence[float], safe_scale: Sequence[float]) -> Column:
    return F.zip_with(minus(values, _lit(mean)), _lit(safe_scale), lambda x, s: x / s)


def _times(a: Column, by: Sequence[float]) -> Column:
    return F.zip_with(a, _lit(by), lambda x, s: x * s)


def project_out_standardized(values: Column, of: Column, components, mean, spread, safe_scale, strength: float = 1.0) -> Column:
    """Values less strength times the part of `of` along the components, in units of safe_scale from mean, times spread.

    `of` is the values themselves (row by row) or the mean of their section, which moves all its rows alike.
    """
    return minus(values, scale(_times(_rows(components, standardized(of, mean, safe_scale)), spread), strength))


def add_standardized(values: Column, direction: Sequence[float], spread: Sequence[float], strength: float = 1.0) -> Column:
    """Values plus strength times a direction that is given in units of spread."""
    return add(values, scale(_times(_lit(direction), spread), strength))


def swap_standardized(values: Column, donor: Column, own: Column, components, mean, spread, safe_scale, strength: float = 1.0) -> Column:
    """Values moved along the components by the difference of the donor's and the own standardized values, times spread."""
    part = lambda v: _rows(components, standardized(v, mean, safe_scale))
    return add(values, scale(_times(minus(part(donor), part(own)), spread), strength))


def random_components(count: int, size: int, seed: int, layer: int = 0):
    """Orthonormal rows from a generator seeded with the sum of seed and layer."""
    import numpy as np

    q, r = np.linalg.qr(np.random.default_rng(seed + layer).standard_normal((size, count)))
    return (q * np.sign(np.diag(r))).T


def random_control(values: Column, of: Column, components, random, mean, spread, safe_scale, strength: float = 1.0, match_norm: bool = True) -> Column:
    """Like project_out_standardized with random components; with match_norm, moved as far as the true ones would."""
    z = standardized(of, mean, safe_scale)
    move = _times(_rows(random, z), spread)
    if match_norm:
        move = scale(move, F.coalesce(F.try_divide(norm(_times(_rows(components, z), spread)), norm(move)), F.lit(0.0)))
    return minus(values, scale(move, strength))


def delta_transport(values: Column, donor: Column, target_source: Column, weight: float, strength: float = 1.0) -> Column:
    """Values moved by weight and strength times what the donor's source differs from the target's."""
    return add(values, scale(minus(donor, target_source), weight * strength))


def path_mask(edges: DataFrame) -> DataFrame:
    """Per write layer: its edges (read_layer, position) as a sorted list, and their number."""
    return edges.groupBy("write_layer").agg(F.array_sort(F.collect_set(F.struct("read_layer", "position"))).alias("edges")).withColumn("n_edges", F.size("edges").cast("long"))


def activation_bank(rows: DataFrame, layers: Sequence[int] = (), keys: DataFrame | None = None) -> DataFrame:
    """Rows of the wanted layers and keys (one column, example_key)."""
    rows = rows.where(F.col("layer").isin(*layers)) if layers else rows
    return rows.join(keys.distinct(), "example_key", "left_semi") if keys is not None else rows


def resolved_operands(writes: DataFrame, sources: DataFrame, components: DataFrame) -> DataFrame:
    """(write_layer, source_layer, vector, reason): the operand of each write layer, or why it is skipped.

    writes is (write_layer, source_layer, component), sources (source_layer, raw) and components (source_layer,
    component, vector); without a component the raw vector is taken.
    """
    known = sources.select("source_layer", "raw", F.lit(True).alias("_known"))
    found = writes.join(known, "source_layer", "left").join(components, ["source_layer", "component"], "left")
    reason = F.when(F.col("_known").isNull(), "missing_layer").when(F.col("component").isNotNull() & F.col("vector").isNull(), "missing_component")
    vector = F.when(reason.isNull(), F.when(F.col("component").isNull(), F.col("raw")).otherwise(F.col("vector")))
    return found.select("write_layer", "source_layer", vector.alias("vector"), reason.alias("reason"))


def interchange(target: DataFrame, donor: DataFrame, pairs: DataFrame) -> DataFrame:
    """target's rows with the donor's values, the n-th position for the n-th; pairs has target_key and donor_key."""
    nth = lambda df: df.withColumn("nth", F.row_number().over(Window.partitionBy("example_key").orderBy("token_pos")))
    given = nth(donor).select(F.col("example_key").alias("donor_key"), "nth", F.col("values").alias("donor_values"))
    placed = nth(target).join(pairs, F.col("example_key") == F.col("target_key"))
    return placed.join(given, ["donor_key", "nth"]).select("example_key", "token_pos", "donor_key", F.col("donor_values").alias("values"))


def unequal_pairs(target: DataFrame, donor: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs whose sides have different numbers of tokens, which an interchange must not have."""
    count = lambda df, name: df.groupBy(F.col("example_key").alias(f"{name}_key")).agg(F.count("*").alias(f"{name}_tokens"))
    return pairs.join(count(target, "target"), "target_key").join(count(donor, "donor"), "donor_key").where("target_tokens != donor_tokens")


def residual_path(values: Column, donor: Column, source: Column, weight: float, strength: float = 1.0) -> Column:
    """Values moved by weight and strength times the donor less the source."""
    return add(values, scale(minus(donor, source), weight * strength))


def pair_cases(rows: DataFrame, case: str, target: Column | str, donor: Column | str) -> DataFrame:
    """case, target_key, donor_key, status, reason: cases with one target and one donor are ok, others are skipped."""
    target, donor = condition(target), condition(donor)
    counted = rows.groupBy(case).agg(
        F.count_if(target).alias("t"),
        F.count_if(donor).alias("d"),
        F.max(F.when(target, F.col("example_key"))).alias("target_key"),
        F.max(F.when(donor, F.col("example_key"))).alias("donor_key"),
    )
    reason = F.when(F.col("t") == 0, "no target").when(F.col("d") == 0, "no donor").when(F.col("t") > 1, "several targets").when(F.col("d") > 1, "several donors")
    counted = counted.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("skipped"))
    good = F.col("status") == "ok"
    return counted.select(case, *(F.when(good, F.col(k)).alias(k) for k in ("target_key", "donor_key")), "status", "reason")


def patch_stats(rows: DataFrame, keys: Sequence[str], before: str, after: str) -> DataFrame:
    """Per group: tokens, mean norms before and after, and the norm of all changes together."""
    change = minus(doubles(after), doubles(before))
    square = dot(change, change)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("tokens"), F.avg(norm(doubles(before))).alias("norm_before"), F.avg(norm(doubles(after))).alias("norm_after"), F.sqrt(F.sum(square)).alias("delta_norm")
    )


def compare(baseline: DataFrame, variant: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Rows of both with the difference of each metric; keys that one side lacks have status skipped."""
    b, v = (df.select(key, *[F.col(m).alias(f"{n}_{m}") for m in metrics], F.lit(True).alias(f"in_{n}")) for df, n in ((baseline, "baseline"), (variant, "variant")))
    both = b.join(v, key, "full_outer")
    ok = F.col("in_baseline") & F.col("in_variant")
    deltas = [(F.col(f"variant_{m}") - F.col(f"baseline_{m}")).alias(f"delta_{m}") for m in metrics]
    return both.select(key, *deltas, F.when(ok, "ok").otherwise("skipped").alias("status"))
