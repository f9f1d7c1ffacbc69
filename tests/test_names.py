"""Weight names against pairs written by hand, and buckets looked up by index."""

import random

import pytest
from pixelloom.functions import naming
from pixelloom.operators import buckets
from pyspark.sql import functions as F

UNET = {
    "conv_out.bias": "out.2.bias",
    "add_embedding.linear_2.weight": "label_emb.0.2.weight",
    "down_blocks.0.resnets.0.conv1.weight": "input_blocks.1.0.in_layers.2.weight",
    "down_blocks.0.resnets.1.norm2.bias": "input_blocks.2.0.out_layers.0.bias",
    "down_blocks.0.downsamplers.0.conv.bias": "input_blocks.3.0.op.bias",
    "down_blocks.1.attentions.0.transformer_blocks.1.attn1.to_q.weight": "input_blocks.4.1.transformer_blocks.1.attn1.to_q.weight",
    "down_blocks.1.downsamplers.0.conv.weight": "input_blocks.6.0.op.weight",
    "down_blocks.2.resnets.1.conv2.weight": "input_blocks.8.0.out_layers.3.weight",
    "up_blocks.0.resnets.0.time_emb_proj.weight": "output_blocks.0.0.emb_layers.1.weight",
    "up_blocks.0.attentions.2.proj_out.bias": "output_blocks.2.1.proj_out.bias",
    "up_blocks.0.upsamplers.0.conv.weight": "output_blocks.2.2.conv.weight",
    "up_blocks.1.upsamplers.0.conv.bias": "output_blocks.5.2.conv.bias",
    "up_blocks.2.resnets.2.conv_shortcut.bias": "output_blocks.8.0.skip_connection.bias",
    "mid_block.resnets.0.norm1.weight": "middle_block.0.in_layers.0.weight",
    "mid_block.attentions.0.proj_in.weight": "middle_block.1.proj_in.weight",
    # What the network hasn't stays.
    "down_blocks.0.attentions.0.proj_in.weight": "down_blocks.0.attentions.0.proj_in.weight",
    "up_blocks.2.attentions.0.proj_in.weight": "up_blocks.2.attentions.0.proj_in.weight",
    "down_blocks.3.attentions.0.proj_in.weight": "down_blocks.3.attentions.0.proj_in.weight",
    "down_blocks.x.y": "down_blocks.x.y",
    "other": "other",
}
VAE = {
    "encoder.down_blocks.3.resnets.0.norm1.weight": "encoder.down.3.block.0.norm1.weight",
    "encoder.down_blocks.2.downsamplers.0.conv.weight": "encoder.down.2.downsample.conv.weight",
    "decoder.up_blocks.0.resnets.0.conv1.bias": "decoder.up.3.block.0.conv1.bias",
    "decoder.up_blocks.3.resnets.2.conv_shortcut.weight": "decoder.up.0.block.2.nin_shortcut.weight",
    "decoder.up_blocks.0.upsamplers.0.conv.bias": "decoder.up.3.upsample.conv.bias",
    "encoder.mid_block.resnets.1.conv2.bias": "encoder.mid.block_2.conv2.bias",
    "decoder.mid_block.attentions.0.to_k.bias": "decoder.mid.attn_1.k.bias",
    "encoder.conv_norm_out.bias": "encoder.norm_out.bias",
    "quant_conv.weight": "quant_conv.weight",
    "encoder.down_blocks.4.resnets.0.x": "encoder.down_blocks.4.resnets.0.x",
}


@pytest.mark.parametrize(("rename", "pairs"), [(naming.unet_key, UNET), (naming.vae_key, VAE)])
def test_names(spark, rename, pairs):
    rows = spark.createDataFrame([(n,) for n in pairs], "n string").select("n", rename(F.col("n")).alias("r")).collect()
    assert {r.n: r.r for r in rows} == pairs


def test_no_two_names_of_a_network_meet(spark):
    kinds = [("down", "resnets", 2), ("down", "attentions", 2), ("down", "downsamplers", 1), ("up", "resnets", 3), ("up", "attentions", 3), ("up", "upsamplers", 1)]
    names = [f"{s}_blocks.{lv}.{k}.{n}.conv.weight" for s, k, m in kinds for lv in range(3) for n in range(m)] + [f"mid_block.{k}.{n}.w" for k, n in (("resnets", 0), ("resnets", 1), ("attentions", 0))]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(naming.unet_key(F.col("n")).alias("r"))
    assert rows.distinct().count() == len(names)


@pytest.mark.parametrize("searched", [0, 4096])
@pytest.mark.parametrize("n", [0, 1, 2, 9, 64, 65])
def test_indexes_find_their_bucket(spark, monkeypatch, searched, n):
    monkeypatch.setattr(buckets, "SEARCHED", searched)
    rng = random.Random(n)
    rows, at = [], 0
    for k in range(n):
        size = rng.choice([0, 1, 2, 50])
        rows.append((k, k + 1, size, at, at + size))
        at += size
    sizes = spark.createDataFrame(rows, "w long, h long, n long, start_index long, end_index long")
    if searched < n and not at:
        return
    indexes = spark.range(-2, at + 3).withColumnRenamed("id", "idx")
    expected = sorted((i, w, h, i - a) for w, h, _, a, z in rows for i in range(a, z))
    if n or searched:
        found = buckets.locate(indexes, sizes)
        assert sorted(map(tuple, found.collect())) == expected
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_lookup_plans_no_product_at_any_threshold(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    items = spark.range(500).select(F.struct((F.col("id") % 9).alias("w"), F.lit(8).alias("h")).alias("bucket"))
    try:
        for threshold in ("-1", "100", "10485760"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            found = buckets.locate(spark.range(500).withColumnRenamed("id", "idx"), buckets.inventory(items))
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert found.count() == 500 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
