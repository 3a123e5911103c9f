"""Classes of tensors by name, shape and dtype, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Module names that decide the class.
MM_MARKERS = ("vision_tower", "audio_tower", "vision_embedder", "embed_vision", "embed_audio", "vision_model", "multi_modal_projector", "mm_projector", ".visual.")
ATTN = ("q_proj", "k_proj", "v_proj", "o_proj", "qkv_proj", "out_proj")
LINATTN = ("linear_attn",)
MLP = ("gate_proj", "up_proj", "down_proj", "gate_up_proj", "w1", "w2", "w3")
PLE_PROJ = ("per_layer_input_gate", "per_layer_projection", "per_layer_model_projection")
MIN_DIM = 256
BLOCK = r"^(.*?\blayers\.(\d+))\."
PACKED_CLASSES = ("linear", "embed", "ple", "mm")


def classify(name: Column, shape: Column, dtype: Column) -> Column:
    """struct<cls, sub, layer, block>: the first rule that holds."""
    parts = F.split(name, r"\.")
    has = lambda names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    dotted = F.concat(F.lit("."), name, F.lit("."))
    mm = F.lit(False)
    for marker in MM_MARKERS:
        mm = mm | dotted.contains(marker)
    block = F.nullif(F.regexp_extract(name, BLOCK, 1), F.lit(""))
    layer = F.when(~name.startswith("mtp."), F.nullif(F.regexp_extract(name, BLOCK, 2), F.lit("")).cast("int"))
    dims = F.size(shape)
    matrix = (dtype == "BF16") & dims.isin(2, 3) & (F.array_min(F.slice(shape, -2, 2)) >= MIN_DIM)
    matrix = F.when(dims >= 2, matrix).otherwise(False)
    weight = (F.element_at(parts, -1) == "weight") | ((dims == 3) & F.array_contains(parts, "experts"))
    sub = F.when(F.array_contains(parts, "experts"), "experts").when(has(LINATTN), "linattn").when(has(ATTN), "attn").when(has(MLP), "mlp").when(has(PLE_PROJ), "ple_proj")
    other = F.when(F.exists(parts, lambda p: p.contains("norm")), "norm").otherwise("other")
    nowhere = F.lit(None).cast("int"), F.lit(None).cast("string")
    made = lambda cls, sub, layer, block: F.struct(F.lit(cls).alias("cls"), sub.alias("sub"), layer.alias("layer"), block.alias("block"))
    return (
        F.when(mm, made("mm", F.lit("mm"), layer, block))
        .when(F.array_contains(parts, "embed_tokens_per_layer"), made("ple", F.lit("ple"), *nowhere))
        .when(name.endswith("embed_tokens.weight"), made("embed", F.lit("embed_tokens"), *nowhere))
        .when(name.endswith("lm_head.weight"), made("embed", F.lit("lm_head"), *nowhere))
        .when(matrix & weight & sub.isNotNull(), made("linear", sub, layer, block))
        .otherwise(made("other", other, layer, block))
    )


def packable(cls: Column, shape: Column, dtype: Column, classes: tuple[str, ...] = PACKED_CLASSES) -> Column:
    """BF16 matrices and stacks of the classes; of mm, those of two dimensions of at least 256."""
    small = F.array_min(F.slice(shape, -2, 2)) < MIN_DIM
    return (dtype == "BF16") & F.size(shape).isin(2, 3) & cls.isin(*classes) & ~((cls == "mm") & small)
