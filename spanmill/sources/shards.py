"""Runs as folders of safetensors shards, one file a prompt, read and written as a Spark data source.

A shard is a header's length (eight bytes), a JSON header and raw tensors. A reader plans its files
from listings, several small ones a partition, prunes folders by what is asked of the run's keys, and
of each file fetches the header and the byte ranges of the tensors that the schema needs. A writer
takes a prompt's rows together, writes each file under a name of its own task and puts it in place
when all tasks are done.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schemas import RUN_KEYS

FORMAT = "rollout_shards"
#: Bytes of files that one partition reads, a larger file aside.
PARTITION_BYTES = 64 << 20
#: Folders of artifacts under a run's, and the tensors of their files.
FOLDERS = {"rollouts": "rollout_shards", "embeddings": "embedding_shards", "rewards": "reward_shards", "judgments": "judgment_shards"}
_RUN = ", ".join(f"{k} string" for k in RUN_KEYS)
SCHEMAS = {
    "rollouts": f"{_RUN}, prompt_id int, prompt string, prompt_token_ids array<bigint>, rollout_idx int, text string, token_ids array<bigint>, seq_len bigint, step_entropy array<float>, step_logprobs array<array<float>>",
    "embeddings": f"{_RUN}, embedding_key string, prompt_id int, rollout_idx int, embedding array<float>",
    "rewards": f"{_RUN}, reward_name string, prompt_id int, rollout_idx int, reward float",
    "judgments": f"{_RUN}, judge_name string, prompt_id int, r int, c int, rollout_idx_r int, rollout_idx_c int, is_similar boolean, status string, text string",
}
#: The column that names the folder of an artifact of which a run may have several.
NAMED = {"embeddings": "embedding_key", "rewards": "reward_name", "judgments": "judge_name"}
_DTYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "|b1"}
_LOGPROBS = "sequence_step_logprobs.{:05d}"


def filesystem(path: str):
    """(file system, path in it) of a local path or a URI that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path) if not path.startswith("file:") else (fs.LocalFileSystem(), path[5:])


class Shard:
    """An open shard: its texts and the byte ranges of its tensors. Nothing but the header is read until a tensor is asked for."""

    def __init__(self, file):
        self.file = file
        (length,) = struct.unpack("<Q", file.read(8))
        header = json.loads(file.read(length))
        self.start, self.texts, self.places = 8 + length, header.pop("__metadata__", {}), header

    def __contains__(self, name: str) -> bool:
        return name in self.places

    def shape(self, name: str) -> list[int]:
        return self.places[name]["shape"]

    def tensor(self, name: str) -> np.ndarray:
        place = self.places[name]
        begin, end = place["data_offsets"]
        self.file.seek(self.start + begin)
        raw = self.file.read(end - begin)
        if len(raw) != end - begin:
            raise ValueError(f"the file ends within {name}")
        if place["dtype"] == "BF16":  # the upper half of a float
            out = (np.frombuffer(raw, dtype="<u2").astype("<u4") << 16).view("<f4")
        else:
            out = np.frombuffer(raw, dtype=_DTYPES[place["dtype"]])
        return out.reshape(place["shape"])


def encoded(tensors: dict[str, np.ndarray], texts: dict[str, str]) -> bytes:
    """A shard's bytes: tensors in order of their names, the header padded with spaces to eight bytes."""
    names = {np.dtype(v): k for k, v in _DTYPES.items()}
    header: dict = {"__metadata__": texts} if texts else {}
    at, raw = 0, []
    for name, x in sorted(tensors.items()):
        own = np.ascontiguousarray(x).tobytes()
        header[name] = {"dtype": names[x.dtype], "shape": list(x.shape), "data_offsets": [at, at + len(own)]}
        raw.append(own)
        at += len(own)
    head = json.dumps(header, separators=(",", ":")).encode()
    head += b" " * (-len(head) % 8)
    return b"".join([struct.pack("<Q", len(head)), head, *raw])


def _split(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A flat tensor as a list for each length."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))


def _rollouts(shard: Shard, wanted: set[str]) -> tuple[int, dict[str, pa.Array]]:
    texts = json.loads(shard.texts["generated_texts"])
    n, out = len(texts), {"text": pa.array(texts, pa.string()), "rollout_idx": pa.array(range(len(texts)), pa.int32())}
    out["prompt"] = pa.array([shard.texts["prompt"]] * n, pa.string())
    if "prompt_token_ids" in wanted:
        own = shard.tensor("prompt_token_ids")
        out["prompt_token_ids"] = _split(np.tile(own, n), np.full(n, len(own)))
    if wanted & {"seq_len", "token_ids", "step_entropy"}:
        lengths = shard.tensor("sequence_lengths")
        out["seq_len"] = pa.array(lengths)
        for column, name in (("token_ids", "generated_token_ids_flat"), ("step_entropy", "step_conditional_entropy_flat")):
            if column in wanted:
                out[column] = _split(shard.tensor(name), lengths)
    if "step_logprobs" in wanted:
        if _LOGPROBS.format(0) in shard:
            own = [shard.tensor(_LOGPROBS.format(i)) for i in range(n)]
            steps = _split(np.concatenate([x.ravel() for x in own]), np.concatenate([np.full(len(x), x.shape[1]) for x in own]))
            out["step_logprobs"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]).astype(np.int32)), steps)
        else:
            out["step_logprobs"] = pa.nulls(n, pa.list_(pa.list_(pa.float32())))
    return n, out


def _columns(artifact: str, shard: Shard, wanted: set[str]) -> tuple[int, dict[str, pa.Array]]:
    """How many rows a shard has, and those of its columns that are wanted."""
    if artifact == "rollouts":
        return _rollouts(shard, wanted)
    if artifact == "judgments":
        asked = json.loads(shard.texts["pair_judgments"])
        r, c = (np.array([x[k] for x in asked], dtype=np.int32) for k in ("row", "column"))
        out = {"r": pa.array(r + 1), "c": pa.array(c + 1), "is_similar": pa.array([x["is_similar"] for x in asked], pa.bool_()), "status": pa.array([x["status"] for x in asked], pa.string()), "text": pa.array([x["text"] for x in asked], pa.string())}
        if wanted & {"rollout_idx_r", "rollout_idx_c"}:
            drawn = shard.tensor("subsample_indices").astype(np.int32)
            out |= {"rollout_idx_r": pa.array(drawn[r]), "rollout_idx_c": pa.array(drawn[c])}
        return len(asked), out
    name, column = ("embeddings", "embedding") if artifact == "embeddings" else ("rewards", "reward")
    n = shard.shape(name)[0]
    out = {"rollout_idx": pa.array(range(n), pa.int32())}
    if column in wanted:
        x = shard.tensor(name).astype(np.float32)
        out[column] = pa.array(x) if x.ndim == 1 else _split(x.ravel(), np.full(n, x.shape[1]))
    return n, out


@dataclass
class Files(InputPartition):
    """(path, values of the key columns) of the shards that one task reads."""

    files: list[tuple[str, dict]] = field(default_factory=list)


class ShardReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.root, self.artifact = schema, options["path"].rstrip("/"), options.get("artifact", "rollouts")
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.only: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        """Equalities of keys choose folders and files; all else is left to Spark."""
        keys = {*RUN_KEYS, "prompt_id", NAMED.get(self.artifact)}
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in keys:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[f.attribute[0]] = self.only.get(f.attribute[0], values) & values
            else:
                yield f

    def _listed(self) -> Iterator[tuple[str, int, dict]]:
        """(path, bytes, keys) of the shards; a folder that a filter rules out isn't listed."""
        from pyarrow import fs

        system, root = filesystem(self.root)
        levels = [*RUN_KEYS, None, *([NAMED[self.artifact]] if self.artifact in NAMED else [])]

        def folders(path: str, depth: int, keys: dict) -> Iterator[tuple[str, int, dict]]:
            for info in sorted(system.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda i: i.base_name):
                name = info.base_name
                if depth == len(levels):
                    stem, ending = posixpath.splitext(name)
                    if ending == ".safetensors" and stem.isdigit() and int(stem) in self.only.get("prompt_id", {int(stem)}):
                        yield info.path, info.size, keys | {"prompt_id": int(stem)}
                elif info.type == fs.FileType.Directory:
                    level = levels[depth]
                    if name == FOLDERS[self.artifact] if level is None else name in self.only.get(level, {name}):
                        yield from folders(info.path, depth + 1, keys if level is None else keys | {level: name})

        return folders(root, 0, {})

    def partitions(self) -> list[Files]:
        out, held = [], 0
        for path, size, keys in self._listed():
            if not out or held + size > self.bytes:
                out.append(Files())
                held = 0
            out[-1].files.append((path, keys))
            held += size
        return out or [Files()]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(self.schema)
        system, _ = filesystem(self.root)
        for path, keys in partition.files:
            with system.open_input_file(path) as file:
                n, found = _columns(self.artifact, Shard(file), set(shape.names))
            columns = [pa.array([keys[f.name]] * n, f.type) if f.name in keys else found[f.name].cast(f.type) for f in shape]
            yield pa.RecordBatch.from_arrays(columns, schema=shape)


@dataclass
class Written(WriterCommitMessage):
    """(name in the task, name in place) of the files that a task wrote."""

    files: list[tuple[str, str]]


class ShardWriter(DataSourceArrowWriter):
    """Rows come sorted by the keys, prompt and rollout (``write_shards`` sees to it); a file is written when its prompt's last row has come."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.root, self.artifact = schema, options["path"].rstrip("/"), options.get("artifact", "rollouts")

    def _target(self, key: tuple) -> str:
        *run, prompt = key
        return "/".join([*run[:4], FOLDERS[self.artifact], *run[4:], f"{prompt:06d}.safetensors"])

    def _judged(self, rows: list[dict]) -> bytes:
        m = max(max(r["r"], r["c"]) for r in rows)
        similar, drawn = np.zeros((m, m), dtype=bool), np.zeros(m, dtype=np.int64)
        for r in rows:
            similar[r["r"] - 1, r["c"] - 1] = bool(r["is_similar"])
            drawn[[r["r"] - 1, r["c"] - 1]] = [r["rollout_idx_r"] or 0, r["rollout_idx_c"] or 0]
        asked = [{"row": r["r"] - 1, "column": r["c"] - 1, "is_similar": bool(r["is_similar"]), "status": r["status"], "text": r["text"] or ""} for r in rows]
        return encoded({"judgments": similar, "subsample_indices": drawn}, {"pair_judgments": json.dumps(asked)})

    def _shard(self, rows: list[dict]) -> bytes:
        if self.artifact == "judgments":
            return self._judged(rows)
        if [r["rollout_idx"] for r in rows] != list(range(len(rows))):
            raise ValueError("a prompt's rollouts are numbered from 0 without gaps")
        if self.artifact == "embeddings":
            return encoded({"embeddings": np.array([r["embedding"] for r in rows], dtype=np.float32)}, {})
        if self.artifact == "rewards":
            return encoded({"rewards": np.array([r["reward"] for r in rows], dtype=np.float32)}, {})
        flat = lambda name, kind: np.concatenate([np.asarray(r[name] or [], dtype=kind) for r in rows])
        tensors = {"prompt_token_ids": np.asarray(rows[0]["prompt_token_ids"] or [], dtype=np.int64), "sequence_lengths": np.array([len(r["token_ids"]) for r in rows], dtype=np.int64)}
        tensors |= {"generated_token_ids_flat": flat("token_ids", np.int64), "step_conditional_entropy_flat": flat("step_entropy", np.float32)}
        if any(r["step_logprobs"] is not None for r in rows):
            for i, r in enumerate(rows):
                widest = max((len(s) for s in r["step_logprobs"] or []), default=0)
                tensors[_LOGPROBS.format(i)] = np.array([[*s, *[-np.inf] * (widest - len(s))] for s in r["step_logprobs"] or []], dtype=np.float32).reshape(-1, widest)
        return encoded(tensors, {"prompt": rows[0]["prompt"] or "", "generated_texts": json.dumps([r["text"] or "" for r in rows])})

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = filesystem(self.root)
        keys = [*RUN_KEYS, *([NAMED[self.artifact]] if self.artifact in NAMED else []), "prompt_id"]
        task, files, own, held = uuid.uuid4().hex, [], None, []

        def flush() -> None:
            if held:
                target = f"{root}/{self._target(own)}"
                name = f"{posixpath.dirname(target)}/.{posixpath.basename(target)}.{task}"
                system.create_dir(posixpath.dirname(target), recursive=True)
                with system.open_output_stream(name) as out:
                    out.write(self._shard(held))
                files.append((name, target))
                held.clear()

        for batch in iterator:
            for row in batch.to_pylist():
                if (key := tuple(row[k] for k in keys)) != own:
                    flush()
                    own = key
                held.append(row)
        flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Files take their places; a prompt's older shard gives way."""
        system, _ = filesystem(self.root)
        for message in messages:
            for name, target in message.files if message else ():
                system.move(name, target)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = filesystem(self.root)
        for message in messages:
            for name, _ in message.files if message else ():
                system.delete_file(name)


class ShardSource(DataSource):
    """``path`` is the root of the runs' folders, ``artifact`` one of ``FOLDERS``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMAS[self.options.get("artifact", "rollouts")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return ShardReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ShardWriter(schema, self.options)


def read_shards(spark: SparkSession, root: str, artifact: str = "rollouts", columns: list[str] | None = None, **options: str) -> DataFrame:
    """An artifact's rows. Only the tensors behind ``columns`` (all unless given) are read; filters on the run's keys, the
    artifact's name and prompt_id choose files. Pairs of judgments are numbered from 1, as everywhere here."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ShardSource)
    whole = StructType.fromDDL(SCHEMAS[artifact])
    schema = StructType([whole[c] for c in columns]) if columns else whole
    return spark.read.format(FORMAT).schema(schema).option("artifact", artifact).options(**options).load(root)


def write_shards(rows: DataFrame, root: str, artifact: str = "rollouts") -> None:
    """A file for each prompt; one that is there already is replaced, others stay. Columns that ``rows`` lacks are null."""
    rows.sparkSession.dataSource.register(ShardSource)
    shaped = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SCHEMAS[artifact])))
    keys = [*RUN_KEYS, *([NAMED[artifact]] if artifact in NAMED else []), "prompt_id"]
    shaped.repartition(*keys).sortWithinPartitions(*keys, *(("r", "c") if artifact == "judgments" else ("rollout_idx",))).write.format(FORMAT).mode("append").option("artifact", artifact).save(root)
