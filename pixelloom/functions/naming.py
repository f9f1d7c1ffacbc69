"""Paths, sizes, type names, adapter metadata and renaming rules."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "gif", "bmp", "tiff", "webp", "avif")


def storage_path(root: Column, key: Column, suffix: str) -> Column:
    """root/ab/cd/abcd....suffix"""
    return F.concat_ws("/", root, F.substring(key, 1, 2), F.substring(key, 3, 2), F.concat(key, F.lit(f".{suffix}")))


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(rf"\.({'|'.join(IMAGE_SUFFIXES)})$")


def is_hidden(path: Column) -> Column:
    """Whether a component of a path, relative to what is searched, begins with a dot."""
    return F.exists(F.split(path, "/"), lambda p: p.startswith("."))


def is_sharded_output(path: Column) -> Column:
    """Two folders of two characters, then a name of 64 characters."""
    return path.rlike(r"(^|/)[^/]{2}/[^/]{2}/[^/]{64}\.npz$")


def relative_key(path: Column, base: Column) -> Column:
    """The path below ``base`` without its suffix."""
    below = F.when(path.startswith(F.concat(base, F.lit("/"))), F.substring(path, F.length(base) + 2, F.length(path))).otherwise(path)
    return F.regexp_replace(below, r"(?<=[^/])\.[^./]*$", "")


def is_remote(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https")


def direct_url(url: Column, host: str) -> Column:
    """A download address for a page that shows a file on ``host``."""
    return F.when(url.contains(host) & url.contains("/blob/"), F.replace(url, F.lit("/blob/"), F.lit("/resolve/"))).otherwise(url)


def cached_name(url: Column) -> Column:
    """File name in the model cache: the address's own if it looks like a model."""
    name = F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), "([^/]*)$", 1)
    return F.when(name.rlike(r"\.(safetensors|ckpt|pt|pth)$"), name).otherwise(F.lit("vae_model.safetensors"))


def human_size(n: Column) -> Column:
    """1.2B, 3.4M, 5.6K, or the number itself below a thousand; the digit is rounded half up, in whole numbers of up to 26 digits."""

    over = lambda x, by: F.call_function("div", x, F.lit(by))

    def short(by: int, unit: str) -> Column:
        tenths = over(n, by // 10) + (n % (by // 10) >= by // 20).cast("int")
        return F.concat(over(tenths, 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(unit))

    return F.when(n >= 1_000_000_000, short(10**9, "B")).when(n >= 1_000_000, short(10**6, "M")).when(n >= 1_000, short(10**3, "K")).otherwise(n.cast("string"))


# Names by which number types are asked for.
DTYPES = {
    "float16": ("float16", "half", "fp16"),
    "float32": ("float32", "float", "fp32"),
    "float64": ("float64", "double", "fp64"),
    "bfloat16": ("bfloat16", "bf16"),
}


def dtype_name(name: Column) -> Column:
    """The type's own name; an unknown one is an error."""
    known = [F.when(name.isin(*names), F.lit(dtype)) for dtype, names in DTYPES.items()]
    return F.coalesce(*known, F.raise_error(F.concat(F.lit("unknown dtype "), name)))


def adapter_metadata(model_path: Column, mode: Column, dim: Column, alpha: Column, factor: Column) -> Column:
    """Metadata by which other programs load a saved adapter."""
    old = F.lower(model_path).contains("sd15")
    base = F.create_map(
        F.lit("ss_network_dim"), dim.cast("string"),
        F.lit("ss_network_alpha"), alpha.cast("string"),
        F.lit("ss_network_module"), F.lit("lycoris.kohya"),
        F.lit("ss_network_args"), F.concat(F.lit('{"algo": "'), mode, F.lit('"}')),
        F.lit("format"), F.lit("pt"),
        F.lit("ss_base_model_version"), F.when(old, "sd_v1").otherwise("sdxl_v1"),
        F.lit("ss_training_comment"), F.concat(F.lit("LyCORIS "), F.upper(mode), F.lit(" training")),
        F.lit("ss_resolution"), F.when(old, "512,512").otherwise("1024,1024"),
    )
    return F.when(mode == "lokr", F.map_concat(base, F.create_map(F.lit("ss_lokr_factor"), factor.cast("string")))).otherwise(base)


def adapter_key(name: Column) -> Column:
    """Adapter weight names: the prefix goes, and the first six underscores become dots."""
    bare = F.replace(name, F.lit("lycoris_"), F.lit(""))
    return F.when(name.startswith("lycoris_"), F.array_join(F.split(bare, "_", 7), ".")).otherwise(name)


def options_fingerprint(options: dict[str, Column]) -> Column:
    """Eight hex digits of the SHA-256 of options, written as a dictionary of plain values: texts in quotes, whole numbers, True, False and None.

    A text with an apostrophe stands in double quotes unless it holds those, too.
    """

    def said(value: Column) -> Column:
        text, kind = value.cast("string"), F.typeof(value)
        for plain, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            text = F.replace(text, F.lit(plain), F.lit(escaped))
        double = text.contains("'") & ~text.contains('"')
        quoted = F.when(double, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'")))
        return F.coalesce(F.when(kind == "string", quoted).when(kind == "boolean", F.initcap(text)).otherwise(text), F.lit("None"))

    parts = [F.concat(F.lit(f"'{name}': "), said(value)) for name, value in options.items()]
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256), 1, 8)


def feed_forward_factor(factor: Column, ratio: Column) -> Column:
    return F.greatest(F.lit(1), (factor * ratio).cast("int"))


def clip_skip_index(skip: Column, layers: Column) -> Column:
    """Which hidden layer from the end: 0 is the last, k the one k before it, never beyond the first."""
    return F.when(skip == 0, -1).otherwise(F.greatest(-(skip + 1), -layers))


# Parts of weight names (from, to), applied in order.
UNET_EXACT = (
    ("time_embedding.linear_1.weight", "time_embed.0.weight"),
    ("time_embedding.linear_1.bias", "time_embed.0.bias"),
    ("time_embedding.linear_2.weight", "time_embed.2.weight"),
    ("time_embedding.linear_2.bias", "time_embed.2.bias"),
    ("conv_in.weight", "input_blocks.0.0.weight"),
    ("conv_in.bias", "input_blocks.0.0.bias"),
    ("conv_norm_out.weight", "out.0.weight"),
    ("conv_norm_out.bias", "out.0.bias"),
    ("conv_out.weight", "out.2.weight"),
    ("conv_out.bias", "out.2.bias"),
    ("add_embedding.linear_1.weight", "label_emb.0.0.weight"),
    ("add_embedding.linear_1.bias", "label_emb.0.0.bias"),
    ("add_embedding.linear_2.weight", "label_emb.0.2.weight"),
    ("add_embedding.linear_2.bias", "label_emb.0.2.bias"),
)
UNET_RESNET = (
    ("norm1", "in_layers.0"),
    ("conv1", "in_layers.2"),
    ("norm2", "out_layers.0"),
    ("conv2", "out_layers.3"),
    ("time_emb_proj", "emb_layers.1"),
    ("conv_shortcut", "skip_connection"),
)
VAE_FIRST = (
    ("conv_shortcut", "nin_shortcut"),
    ("conv_norm_out", "norm_out"),
    ("mid_block.attentions.0.", "mid.attn_1."),
)
VAE_ATTENTION = (
    ("group_norm.", "norm."),
    ("to_q.", "q."),
    ("to_k.", "k."),
    ("to_v.", "v."),
    ("to_out.0.", "proj_out."),
)
TEXT_ENCODER = (
    ("text_model.encoder.layers.", "transformer.resblocks."),
    ("layer_norm1", "ln_1"),
    ("layer_norm2", "ln_2"),
    (".fc1.", ".c_fc."),
    (".fc2.", ".c_proj."),
    (".self_attn", ".attn"),
    ("text_model.final_layer_norm.", "ln_final."),
    ("text_model.embeddings.token_embedding.weight", "token_embedding.weight"),
    ("text_model.embeddings.position_embedding.weight", "positional_embedding"),
)


@dataclass(frozen=True)
class Layout:
    """How a network is built of levels: residual blocks in each, down and up, and the levels that have attention."""

    levels: int
    down: int
    up: int
    attended_down: tuple[int, ...] = ()
    attended_up: tuple[int, ...] = ()


UNET = Layout(levels=3, down=2, up=3, attended_down=(1, 2), attended_up=(0, 1))
VAE = Layout(levels=4, down=2, up=3)
_NUMBERED = r"(down|up)_blocks\.(\d+)\.(resnets|attentions|downsamplers|upsamplers)\.(\d+)\.(.*)$"
_MIDDLE = r"mid_block\.(resnets|attentions)\.(\d+)\.(.*)$"


def _rewritten(name: Column, rules) -> Column:
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), rules, name)


def _dotted(*parts: Column | str | int) -> Column:
    return F.concat_ws(".", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def unet_key(name: Column, layout: Layout = UNET) -> Column:
    """A name is read as side, level, kind and number, and its place in the flat list of blocks is computed from the layout.

    Input block 0 is the stem; every level has its blocks and then a block of its own that samples down. Output blocks
    have no block for sampling up: that is the third module of a level's last one. Names that the layout hasn't stay.
    """
    exact = F.create_map(*[F.lit(x) for rule in UNET_EXACT for x in rule])
    first = F.coalesce(exact[name], name)
    first = F.when(name.contains("resnets"), _rewritten(first, UNET_RESNET)).otherwise(first)
    part = lambda pattern, k: F.regexp_extract(first, "^" + pattern, k)
    side, level, kind, number, rest = part(_NUMBERED, 1), part(_NUMBERED, 2).try_cast("int"), part(_NUMBERED, 3), part(_NUMBERED, 4).try_cast("int"), part(_NUMBERED, 5)
    module = F.when(kind == "resnets", 0).when(kind == "attentions", 1)
    down, up = (side == "down") & (level < layout.levels), (side == "up") & (level < layout.levels)
    has = lambda levels: (kind == "resnets") | ((kind == "attentions") & level.isin(*levels))
    middle, nth = part(_MIDDLE, 1), part(_MIDDLE, 2).try_cast("int")
    return (
        F.when(down & (number < layout.down) & has(layout.attended_down), _dotted("input_blocks", 1 + level * (layout.down + 1) + number, module, rest))
        .when(down & (number == 0) & (kind == "downsamplers") & rest.startswith("conv."), _dotted("input_blocks", (level + 1) * (layout.down + 1), 0, F.regexp_replace(rest, "^conv", "op")))
        .when(up & (number < layout.up) & has(layout.attended_up), _dotted("output_blocks", level * layout.up + number, module, rest))
        .when(up & (number == 0) & (kind == "upsamplers"), _dotted("output_blocks", (level + 1) * layout.up - 1, 2, rest))
        .when((middle == "resnets") & (nth < 2), _dotted("middle_block", 2 * nth, part(_MIDDLE, 3)))
        .when((middle == "attentions") & (nth == 0), _dotted("middle_block", 1, part(_MIDDLE, 3)))
        .otherwise(first)
    )


def vae_key(name: Column, layout: Layout = VAE) -> Column:
    """As ``unet_key``, but levels stay; the decoder's count from the other end."""
    first = _rewritten(name, VAE_FIRST)
    part = lambda pattern, k: F.regexp_extract(first, r"^(?:encoder|decoder)\." + pattern, k)
    coder = F.regexp_extract(first, r"^(encoder|decoder)\.", 1)
    side, level, kind, number, rest = part(_NUMBERED, 1), part(_NUMBERED, 2).try_cast("int"), part(_NUMBERED, 3), part(_NUMBERED, 4).try_cast("int"), part(_NUMBERED, 5)
    down, up = (coder == "encoder") & (side == "down") & (level < layout.levels), (coder == "decoder") & (side == "up") & (level < layout.levels)
    sampled = (number == 0) & (level < layout.levels - 1)
    middle, nth = part(_MIDDLE, 1), part(_MIDDLE, 2).try_cast("int")
    placed = (
        F.when(down & (kind == "resnets") & (number < layout.down), _dotted("encoder.down", level, "block", number, rest))
        .when(down & (kind == "downsamplers") & sampled, _dotted("encoder.down", level, "downsample", rest))
        .when(up & (kind == "resnets") & (number < layout.up), _dotted("decoder.up", layout.levels - 1 - level, "block", number, rest))
        .when(up & (kind == "upsamplers") & sampled, _dotted("decoder.up", layout.levels - 1 - level, "upsample", rest))
        .when((middle == "resnets") & (nth < 2), F.concat(coder, F.lit(".mid.block_"), _dotted(nth + 1, part(_MIDDLE, 3))))
        .otherwise(first)
    )
    return F.when(name.contains("attentions"), _rewritten(placed, VAE_ATTENTION)).otherwise(placed)


def vae_shape(key: Column, shape: Column) -> Column:
    """Shapes of a VAE's attention weights: linear layers become 1 x 1 convolutions."""
    return F.when(key.rlike(r"mid\.attn_1\.(q|k|v|proj_out)\.weight") & (F.size(shape) != 1), F.concat(shape, F.array(F.lit(1), F.lit(1)))).otherwise(shape)


def text_encoder_key(name: Column) -> Column:
    """All rules in one pass from left to right: a rule's result is never rewritten again.

    Results are set between marks that no name holds, so that later rules can't see into them.
    """
    out = name
    for k, (what, _) in enumerate(TEXT_ENCODER):
        out = F.replace(out, F.lit(what), F.lit(f"\x01{k}\x02"))
    for k, (_, by) in enumerate(TEXT_ENCODER):
        out = F.replace(out, F.lit(f"\x01{k}\x02"), F.lit(by))
    return out
