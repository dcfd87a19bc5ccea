"""Shards of runs: the layout byte by byte, what is read of them, planning, pruning and replacing."""

from __future__ import annotations

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.sources import shards

RUN = {"model_name": "m", "task": "t", "model_variant": "base", "run_name": "r"}


def rollouts(spark, prompts=3, n=2, **run):
    keys = RUN | run
    rows = [(*keys.values(), p, f"prompt {p}", [7, 8], i, f"text {p} {i} é", [1, 2, 3][: i + 1], [0.5 * (p + i + 1)] * (i + 1), [[-0.5, -1.0], [-0.25], [0.0]][: i + 1] if p else None) for p in range(prompts) for i in range(n)]
    return spark.createDataFrame(rows, f"{', '.join(f'{k} string' for k in keys)}, prompt_id int, prompt string, prompt_token_ids array<long>, rollout_idx int, text string, token_ids array<long>, step_entropy array<float>, step_logprobs array<array<float>>")


def test_layout(spark, tmp_path):
    """Length, header, tensors: read here by hand."""
    shards.write_shards(rollouts(spark), str(tmp_path))
    folder = tmp_path / "m" / "t" / "base" / "r" / "rollout_shards"
    assert sorted(x.name for x in folder.iterdir() if not x.name.endswith(".crc")) == ["000000.safetensors", "000001.safetensors", "000002.safetensors"]
    raw = (folder / "000001.safetensors").read_bytes()
    (length,) = struct.unpack("<Q", raw[:8])
    header = json.loads(raw[8 : 8 + length])
    assert (8 + length) % 8 == 0 and json.loads(header["__metadata__"]["generated_texts"]) == ["text 1 0 é", "text 1 1 é"]
    at = lambda name: raw[8 + length + header[name]["data_offsets"][0] : 8 + length + header[name]["data_offsets"][1]]
    assert np.frombuffer(at("sequence_lengths"), "<i8").tolist() == [1, 2] and np.frombuffer(at("generated_token_ids_flat"), "<i8").tolist() == [1, 1, 2]
    assert np.frombuffer(at("step_conditional_entropy_flat"), "<f4").tolist() == [1, 1.5, 1.5] and header["step_conditional_entropy_flat"]["dtype"] == "F32"
    assert header["sequence_step_logprobs.00001"]["shape"] == [2, 2] and np.frombuffer(at("sequence_step_logprobs.00001"), "<f4").tolist() == [-0.5, -1.0, -0.25, -np.inf]
    assert len(raw) == 8 + length + max(x["data_offsets"][1] for k, x in header.items() if k != "__metadata__")


def test_round_trip(spark, tmp_path):
    source = rollouts(spark)
    shards.write_shards(source, str(tmp_path))
    got = {(r.prompt_id, r.rollout_idx): r for r in shards.read_shards(spark, str(tmp_path)).collect()}
    assert len(got) == 6
    for r in source.collect():
        own = got[r.prompt_id, r.rollout_idx]
        assert (own.prompt, own.text, own.token_ids, own.step_entropy, own.prompt_token_ids, own.seq_len) == (r.prompt, r.text, r.token_ids, r.step_entropy, r.prompt_token_ids, len(r.token_ids))
        padded = r.step_logprobs and [[*s, *[-np.inf] * (max(map(len, r.step_logprobs)) - len(s))] for s in r.step_logprobs]
        assert own.step_logprobs == padded


def test_reads_what_is_asked(spark, tmp_path):
    """Texts come from headers: they are there though the tensors are cut off; a tensor in front is read though those behind are gone."""
    shards.write_shards(rollouts(spark), str(tmp_path))
    for path in (tmp_path / "m" / "t" / "base" / "r" / "rollout_shards").glob("*.safetensors"):
        raw = path.read_bytes()
        (length,) = struct.unpack("<Q", raw[:8])
        path.write_bytes(raw[: 8 + length])
    texts = shards.read_shards(spark, str(tmp_path), columns=["prompt_id", "rollout_idx", "text"])
    assert sorted(r.text for r in texts.collect()) == sorted(f"text {p} {i} é" for p in range(3) for i in range(2))
    with pytest.raises(Exception, match="the file ends within"):
        shards.read_shards(spark, str(tmp_path), columns=["seq_len"]).collect()


def test_prunes_folders_and_files(spark, tmp_path):
    """Shards that a filter rules out aren't opened: they are no shards at all."""
    shards.write_shards(rollouts(spark).unionByName(rollouts(spark, model_name="n")), str(tmp_path))
    for path in (tmp_path / "n").rglob("*.safetensors"):
        path.write_bytes(b"x")
    (tmp_path / "m" / "t" / "base" / "r" / "rollout_shards" / "000002.safetensors").write_bytes(b"x")
    read = lambda: shards.read_shards(spark, str(tmp_path), columns=["model_name", "prompt_id", "text"])
    assert read().where("model_name = 'm' and prompt_id in (0, 1)").count() == 4
    assert read().where((F.col("model_name") == "m") & (F.col("prompt_id") == 1) & F.col("text").like("%0 é")).count() == 1
    assert read().where("model_name = 'none'").count() == 0
    with pytest.raises(Exception, match="unpack|buffer"):
        read().where("model_name = 'n'").collect()


def test_plans_several_files_a_partition(spark, tmp_path):
    shards.write_shards(rollouts(spark, prompts=40), str(tmp_path))
    assert shards.read_shards(spark, str(tmp_path), columns=["text"]).rdd.getNumPartitions() == 1
    few = shards.read_shards(spark, str(tmp_path), columns=["text"], partitionBytes="4000")
    assert 2 < few.rdd.getNumPartitions() < 40 and few.count() == 80


def test_replaces_a_prompt(spark, tmp_path):
    """A prompt that is written again takes the place of what was there; nothing half written is left or read."""
    shards.write_shards(rollouts(spark), str(tmp_path))
    shards.write_shards(rollouts(spark, prompts=2, n=3).where("prompt_id = 1"), str(tmp_path))
    got = shards.read_shards(spark, str(tmp_path)).groupBy("prompt_id").count().collect()
    assert {r.prompt_id: r["count"] for r in got} == {0: 2, 1: 3, 2: 2}
    with pytest.raises(Exception, match="numbered from 0"):
        shards.write_shards(rollouts(spark).where("rollout_idx = 1"), str(tmp_path))
    assert shards.read_shards(spark, str(tmp_path)).count() == 7
    assert shards.read_shards(spark, str(tmp_path / "nowhere")).count() == 0


def test_embeddings_and_dtypes(spark, tmp_path):
    rows = rollouts(spark).withColumn("embedding_key", F.lit("e")).withColumn("embedding", F.array(F.col("prompt_id").cast("float"), F.lit(0.5).cast("float")))
    shards.write_shards(rows, str(tmp_path), "embeddings")
    assert sorted((r.embedding_key, r.embedding) for r in shards.read_shards(spark, str(tmp_path), "embeddings").collect()) == sorted(("e", [float(p), 0.5]) for p in range(3) for _ in range(2))
    path = next(tmp_path.rglob("000002.safetensors"))
    half = struct.pack("<4H", *(int(np.float32(x).view(np.uint32)) >> 16 for x in (1.5, -2.0, 0.0, 3.0)))
    head = json.dumps({"embeddings": {"dtype": "BF16", "shape": [2, 2], "data_offsets": [0, 8]}}).encode()
    path.write_bytes(struct.pack("<Q", len(head)) + head + half)
    assert sorted(r.embedding for r in shards.read_shards(spark, str(tmp_path), "embeddings").where("prompt_id = 2").collect()) == [[0.0, 3.0], [1.5, -2.0]]
