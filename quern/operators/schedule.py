"""Training schedules per model size, and the columns derived per checkpoint.

The schedule of a size is computed once on the driver (14 rows); everything that
depends on a step is a Column expression, so a table of any size is enriched by
one broadcast join and code-generated arithmetic. The cumulative learning
rate is defined as the trapezoid sum at whole steps of the cosine decay; that
sum has a closed form (a Dirichlet kernel), so no per-row loop is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.validate import ViolationError

# Training constants of the model ladder.
MAX_SEQUENCE_LENGTH = 2048
TOKEN_LENGTH_MULTIPLIER = 20
MODEL_SIZE_NORMALIZATION = 108_000_000
LEARNING_RATE_EXPONENT = -0.3333333333333333
LEARNING_RATE_BASE = 0.0047
FINAL_LEARNING_RATE_RATIO = 0.01
BATCH_SIZE_COEFFICIENT = 160
BATCH_SIZE_EXPONENT = 0.6666666666666666
BATCH_ROUNDING = 8 * 4
FLOPS_PER_TOKEN_PER_PARAMETER = 6
LENGTH_MULTIPLE = 5

# Settings all sizes share.
MODEL_DEFAULTS: dict[str, object] = {
    "default_seed": 6198, "length_str": "5xC", "lr_warmup_start": 0.0, "weight_tying": False, "alibi": False, "rope": True, "flash_attention": True,
    "attention_dropout": 0.0, "attention_layer_norm": False, "include_bias": False, "layer_norm_type": "rms", "layer_norm_with_affine": True,
    "layer_norm_eps": 1e-6, "bias_for_layer_norm": False, "attention_layer_norm_with_affine": False, "activation_type": "swiglu",
    "residual_dropout": 0.0, "embedding_dropout": 0.0, "max_sequence_length": MAX_SEQUENCE_LENGTH, "vocab_size": 50280, "embedding_size": 50304,
    "eos_token_id": 50279, "pad_token_id": 1, "init_device": "cuda", "init_fn": "normal", "init_std": 0.02, "init_cutoff_factor": 3,
}

# Size, width, heads, layers, MLP ratio, nominal, training and exact parameter counts.
MODEL_SIZES = (
    ("4M", 64, 8, 8, 8, 4_000_000, 3_744_832, 3_744_832),
    ("6M", 96, 8, 8, 8, 6_000_000, 6_010_464, 6_010_464),
    ("8M", 128, 8, 8, 8, 8_000_000, 8_538_240, 8_538_240),
    ("10M", 144, 8, 8, 8, 10_000_000, 9_900_432, 9_900_432),
    ("14M", 192, 8, 8, 8, 14_000_000, 14_380_224, 14_380_224),
    ("16M", 208, 8, 8, 8, 16_000_000, 16_004_560, 16_004_560),
    ("20M", 192, 8, 16, 8, 20_000_000, 19_101_888, 19_101_888),
    ("60M", 384, 12, 16, 8, 60_000_000, 57_078_144, 57_078_144),
    ("90M", 528, 12, 16, 8, 90_000_000, 97_946_640, 97_946_640),
    ("150M", 768, 12, 12, 8, 150_000_000, 150_000_000, 151_898_880),
    ("300M", 1024, 16, 16, 8, 300_000_000, 300_000_000, 319_980_544),
    ("530M", 1344, 16, 16, 8, 530_000_000, 530_000_000, 530_074_944),
    ("750M", 1536, 16, 16, 8, 750_000_000, 750_000_000, 681_297_408),
    ("1B", 2048, 16, 16, 8, 1_000_000_000, 1_000_000_000, 1_176_832_000),
)
EXACT_COUNTS = {m[0]: m[7] for m in MODEL_SIZES}

_TYPES = {str: "string", int: "bigint", float: "double", bool: "boolean"}


def schedule_rows() -> list[dict[str, object]]:
    """The schedule and settings of every size, as plain values."""
    rows = []
    for name, width, heads, layers, ratio, nominal, training, exact in MODEL_SIZES:
        scale = training / MODEL_SIZE_NORMALIZATION
        batch = int(round(BATCH_SIZE_COEFFICIENT * scale**BATCH_SIZE_EXPONENT / BATCH_ROUNDING) * BATCH_ROUNDING)
        per_step = batch * MAX_SEQUENCE_LENGTH
        total = LENGTH_MULTIPLE * TOKEN_LENGTH_MULTIPLIER * training
        warmup = round(training / (batch / MAX_SEQUENCE_LENGTH))
        steps, warmup_steps = math.ceil(total / per_step), math.ceil(warmup / per_step)
        top = LEARNING_RATE_BASE * scale**LEARNING_RATE_EXPONENT
        rows.append({
            "params": name, **MODEL_DEFAULTS, "d_model": width, "n_heads": heads, "n_layers": layers, "mlp_ratio": ratio,
            "nominal_parameter_count": nominal, "training_parameter_count": training, "exact_parameter_count": exact,
            "batch_size": batch, "total_tokens": total, "warmup_tokens": warmup, "lr_max": top, "lr_final": FINAL_LEARNING_RATE_RATIO * top,
            "total_steps": steps, "total_seqs": round(total / MAX_SEQUENCE_LENGTH), "warmup_perc": warmup / total, "warmup_steps": warmup_steps,
            "lr_decay_tokens": total - warmup, "lr_decay_steps": steps - warmup_steps, "tokens_per_step": per_step,
            "compute_per_step": float(per_step * exact * FLOPS_PER_TOKEN_PER_PARAMETER),
        })
    return rows


def schedule_frame(spark: SparkSession) -> DataFrame:
    """One row per model size."""
    rows = schedule_rows()
    schema = ", ".join(f"{k} {_TYPES[type(v)]}" for k, v in rows[0].items())
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema)


DETAIL_COLUMNS = tuple(k for k in schedule_rows()[0] if k != "params")


def learning_rate(step: Column, start: Column, top: Column, final: Column, warmup: Column, decay: Column) -> Column:
    """Linear warmup to ``top``, cosine decay to ``final``, then flat."""
    t = step - warmup
    cosine = final + 0.5 * (top - final) * (1 + F.cos(F.lit(math.pi) * t / decay))
    return F.when(step <= warmup, start + (top - start) * step / warmup).when(t >= decay, final).otherwise(cosine)


def cumulative_learning_rate(step: Column, start: Column, top: Column, final: Column, warmup: Column, decay: Column) -> Column:
    """Sum of the learning rate up to ``step``: warmup in closed form, then trapezoids at whole steps."""
    ramp = lambda t: start * t + (top - start) * t * t / (2 * warmup)
    d = F.least(step - warmup, decay)
    angle = F.lit(math.pi) / decay
    # sum of cos(angle * t) for t = 0..d
    kernel = F.lit(0.5) + F.sin((d + 0.5) * angle) / (2 * F.sin(angle / 2))
    cosines = kernel - (1 + F.cos(angle * d)) / 2
    decayed = final * d + 0.5 * (top - final) * (d + cosines)
    return F.when(step <= 0, F.lit(0.0)).when(step <= warmup, ramp(step)).otherwise(ramp(warmup) + decayed)


def enrich(df: DataFrame, *, details: bool = True) -> DataFrame:
    """Add the schedule columns of each (params, step); rows of unknown sizes are dropped.

    ``step`` must be whole and not negative (see ``require_steps``).
    """
    schedule = schedule_frame(df.sparkSession)
    joined = df.join(F.broadcast(schedule), "params")  # 14 rows
    part = {c: F.col(c).cast("double") for c in ("lr_warmup_start", "lr_max", "lr_final", "warmup_steps", "lr_decay_steps")}
    args = (F.col("step").cast("double"), *part.values())
    tokens = F.col("step") * F.col("tokens_per_step")
    derived = {
        "tokens": tokens,
        "compute": (tokens.cast("double") * F.col("exact_parameter_count") * FLOPS_PER_TOKEN_PER_PARAMETER).cast("double"),
        "lr_at_step": learning_rate(*args),
        "cumulative_lr": cumulative_learning_rate(*args),
    }
    own = [c for c in df.columns if c not in derived and c not in DETAIL_COLUMNS]
    shown = DETAIL_COLUMNS if details else ()
    return joined.select(*own, derived["tokens"].alias("tokens"), derived["compute"].alias("compute"), *[schedule[c] for c in shown], derived["lr_at_step"].alias("lr_at_step"), derived["cumulative_lr"].alias("cumulative_lr"))


def require_steps(df: DataFrame) -> DataFrame:
    """Raise if a step is missing or negative (runs a query)."""
    if df.where("step IS NULL OR step < 0").limit(1).collect():
        raise ViolationError("checkpoint steps must be present and not negative")
    return df


def schedule_contradictions(df: DataFrame, *, full: bool = False) -> DataFrame:
    """One row of counters: how a table's schedule columns contradict its (params, step).

    With ``full`` a NULL counts as a contradiction and all detail columns are compared.
    """
    from quern.functions.scalar import off_schedule

    schedule = schedule_frame(df.sparkSession)
    have = [c for c in ("tokens", "compute", "lr_at_step", "cumulative_lr", *DETAIL_COLUMNS) if c in df.columns]
    expected = enrich(df.select("params", "step").distinct()).select("params", "step", F.struct(*[F.col(c) for c in have]).alias("_e"))
    joined = df.join(expected, ["params", "step"], "left")
    types = dict(schedule.dtypes) | {"tokens": "bigint", "compute": "double", "lr_at_step": "double", "cumulative_lr": "double"}

    def bad(c: str) -> Column:
        a, e = F.col(c), F.col(f"_e.{c}")
        apart = off_schedule(a.cast("double"), e) if types[c] == "double" else a != e
        return F.col("_e").isNotNull() & (F.coalesce(apart, F.lit(False)) | (a.isNull() if full else F.lit(False)))

    details = [c for c in have if c in DETAIL_COLUMNS]
    any_detail = F.lit(False)
    for c in details:
        any_detail = any_detail | bad(c)
    rates = F.lit(False)
    for c in ("lr_at_step", "cumulative_lr"):
        rates = rates | bad(c) if c in have else rates
    none = F.lit(0).cast("bigint")
    return joined.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_e").isNull()).alias("unknown_sizes"), F.count_if(F.col("step") < 0).alias("negative_steps"),
        *[(F.count(c) if c in have else none).alias(f"{c}_present") for c in ("tokens", "compute")],
        *[(F.count_if(bad(c)) if c in have else none).alias(f"{c}_mismatches") for c in ("tokens", "compute")],
        F.count_if(any_detail).alias("detail_mismatches"), F.count_if(rates).alias("rate_mismatches"),
    )
