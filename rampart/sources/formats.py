"""Formats of Spark's Python data sources: SARIF as a sink of partitions, rule packs and unified diffs as readers of files."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from fnmatch import fnmatch
from json.encoder import encode_basestring

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .rule_packs import SCHEMA, rules_of_text, unusable

LEVELS = {"error": "error", "warning": "warning", "info": "note"}
CHUNK = 1 << 20
#: Bytes of text in a frame of a compressed document, and the numbers of the Zstandard seekable format.
FRAME = 1 << 18
SKIPPED, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Bytes after which a task goes on in another file: what lies on disk twice while the document is put together.
PART = 16 << 20


def _files(uri: str):
    """The file system that holds a path, and the path in it; local, or any that Arrow knows, as long as all see it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


# SARIF -------------------------------------------------------------------------------------------


#: Columns of findings that a result can hold; the first four must be there.
COLUMNS = ("rule_id", "severity", "path", "line", "text", "message", "related", "steps", "fix")


def _quoted(x: str | None) -> str:
    return encode_basestring(x) if isinstance(x, str) else json.dumps(x)


def _location(path: str, line: int, message: str | None = None) -> str:
    told = f',"message":{{"text":{_quoted(message)}}}' if message else ""
    return f'"physicalLocation":{{"artifactLocation":{{"uri":{path}}},"region":{{"startLine":{line + 1}}}}}{told}'


def sarif_text(rule_id, severity, path, line, text=None, message=None, related=None, steps=None, fix=None) -> str:
    """The JSON text of ``sarif_result``, put together by hand: every finding passes here."""
    rule, uri = _quoted(rule_id), _quoted(path)
    told = f'{{"ruleId":{rule},"level":"{LEVELS.get(severity, "warning")}","message":{{"text":{_quoted(message) if message else rule}}},"locations":[{{{_location(uri, line)}}}],"partialFingerprints":{{"primaryLocationLineHash":"{hashlib.sha256((text or "").strip(" ").encode()).hexdigest()}"}}'
    if related:
        told += ',"relatedLocations":[' + ",".join(f'{{"id":{k},{_location(_quoted(r["path"]), r["line"], r["message"])}}}' for k, r in enumerate(related)) + "]"
    if steps:
        told += ',"codeFlows":[{"threadFlows":[{"locations":[' + ",".join(f'{{"location":{{{_location(uri, s["line"], s["text"])}}}}}' for s in steps) + "]}]}]"
    if fix is not None:
        told += f',"fixes":[{{"artifactChanges":[{{"artifactLocation":{{"uri":{uri}}},"replacements":[{{"deletedRegion":{{"startLine":{line + 1}}},"insertedContent":{{"text":{_quoted(fix)}}}}}]}}]}}]'
    return told + "}"


def sarif_result(finding: dict) -> dict:
    """A finding as a result. Beside rule_id, severity, path, line (from 0) and text there may be message, steps
    (line, text: the way of tainted data), related (path, line, message) and fix (the line as it should be)."""
    return json.loads(sarif_text(**{c: finding[c] for c in COLUMNS if c in finding}))


def _values(column) -> list:
    """A column of Arrow as Python's values, as ``to_pylist`` has them; much faster for texts and lists of structs."""
    import pyarrow.types as T

    if T.is_string(column.type) or T.is_large_string(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not ((T.is_list(column.type) or T.is_large_list(column.type)) and T.is_struct(column.type.value_type)) or column.values.null_count:
        return column.to_pylist()
    names = [f.name for f in column.type.value_type]
    items = [dict(zip(names, x)) for x in zip(*map(_values, column.values.flatten()))]
    ends = column.offsets.to_pylist()
    return [items[a:b] if there else None for a, b, there in zip(ends, ends[1:], column.is_valid().to_pylist())]


class _Out:
    """Text to files that ``opened`` gives, the next one after ``most`` bytes: as it is, or in Zstandard frames that end
    where an ``add`` does; ``frames`` has their sizes, packed and plain."""

    def __init__(self, opened: Callable, packed: bool, most: float = float("inf")):
        import pyarrow as pa

        self.opened, self.most, self.codec, self.frames = opened, most, pa.Codec("zstd", compression_level=1) if packed else None, bytearray()
        self.out, self.held, self.size = opened(), [], 0

    def __enter__(self) -> _Out:
        return self

    def __exit__(self, *_) -> None:
        self.out.close()

    def add(self, text: str) -> None:
        self.held.append(text)
        self.size += len(text)
        if self.size >= FRAME:
            self.flush()

    def flush(self) -> None:
        if self.size:
            if self.out.tell() >= self.most:
                self.out.close()
                self.out = self.opened()
            text = "".join(self.held).encode()
            if self.codec:
                packed = self.codec.compress(text, asbytes=True)
                self.frames += struct.pack("<II", len(packed), len(text))
                text = packed
            self.out.write(text)
            self.held, self.size = [], 0

    def seek_table(self) -> None:
        """The sizes of all frames, in a frame that readers of Zstandard skip."""
        self.out.write(struct.pack("<II", SKIPPED, len(self.frames) + 9))
        self.out.write(bytes(self.frames))
        self.out.write(struct.pack("<IBI", len(self.frames) // 8, 0, SEEKABLE))


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    #: Its files, in order.
    names: list[str]
    results: int
    #: Sizes of its frames, if it is compressed.
    frames: bytes
    #: By rule the least (path, line, severity) of its findings; as many as there are rules.
    rules: dict[str, tuple]


class _SarifWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, tool: str, version: str):
        self.path, self.overwrite, self.tool, self.version = path, overwrite, tool, version
        self.packed = path.endswith(".zst")
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"
        files, folder = _files(self.parts)  # made here alone: a task that is late after an abort finds no folder
        files.create_dir(folder, recursive=True)

    def write(self, iterator) -> _Part:
        from pyspark import TaskContext

        files, folder = _files(self.parts)
        # Every attempt writes files of its own; only those that the driver hears of are put together.
        told = _Part(TaskContext.get().partitionId(), [], 0, b"", {})

        def opened():
            told.names.append(uuid.uuid4().hex)
            return files.open_output_stream(f"{folder}/{told.names[-1]}")

        with _Out(opened, self.packed, PART) as out:
            for batch in iterator:
                for values in zip(*(_values(batch.column(c)) if c in batch.schema.names else [None] * batch.num_rows for c in COLUMNS)):
                    out.add((",\n" if told.results else "\n") + sarif_text(*values))
                    told.results += 1
                    rule, severity, path, line = values[:4]
                    if (place := (path, line, severity)) != (least := told.rules.setdefault(rule, place)):
                        told.rules[rule] = min(place, least)
            out.flush()
        told.frames = bytes(out.frames)
        return told

    def commit(self, messages) -> None:
        """Copies the parts behind each other into one document, in chunks."""
        files, folder = _files(self.parts)
        _, path = _files(self.path)
        try:
            if not self.overwrite and files.get_file_info(path).type.name != "NotFound":
                raise FileExistsError(self.path)
            told = sorted((m for m in messages if m), key=lambda m: m.partition)
            rules: dict[str, tuple] = {}
            for m in told:
                for rule, place in m.rules.items():
                    rules[rule] = min(place, rules.get(rule, place))
            listed = [{"id": r, "defaultConfiguration": {"level": LEVELS.get(rules[r][2], "warning")}} for r in sorted(rules)]
            driver = {"name": self.tool, "version": self.version, "rules": listed}
            made = f"{folder}/whole"
            with _Out(lambda: files.open_output_stream(made), self.packed) as out:
                head = {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json"}
                out.add(json.dumps(head)[:-1] + ', "runs": [{"tool": {"driver": ' + json.dumps(driver, ensure_ascii=False) + '}, "results": [')
                first = True
                for m in told:
                    if m.results:
                        out.add("" if first else ",")
                        first = False
                        out.flush()
                        for name in m.names:
                            with files.open_input_stream(f"{folder}/{name}") as part:
                                while chunk := part.read(CHUNK):
                                    out.out.write(chunk)
                            files.delete_file(f"{folder}/{name}")  # the parts and the document never lie whole beside each other
                        out.frames += m.frames
                out.add("\n]}]}\n")
                out.flush()
                if self.packed:
                    out.seek_table()
            files.move(made, path)  # the document appears whole
        finally:
            files.delete_dir(folder)

    def abort(self, messages) -> None:
        files, folder = _files(self.parts)
        if files.get_file_info(folder).type.name != "NotFound":
            files.delete_dir(folder)


@dataclass
class _Range(InputPartition):
    #: Where its first frame begins, and the sizes of its frames.
    at: int
    frames: bytes
    value: None = field(default=None)


class _SarifReader(DataSourceReader):
    """The lines of a compressed document that hold results, in ranges of whole frames."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[_Range]:
        files, path = _files(self.path)
        with files.open_input_file(path) as f:
            end = f.size()
            f.seek(max(0, end - 9))
            foot = f.read(9)
            count, _, magic = struct.unpack("<IBI", foot) if len(foot) == 9 else (0, 0, 0)
            if magic != SEEKABLE:
                raise ValueError(f"{self.path}: no Zstandard file with a seek table")
            f.seek(end - 9 - 8 * count)
            table = f.read(8 * count)
        ranges, at, first, begin, held = [], 0, 0, 0, 0
        for k, (packed, plain) in enumerate(struct.iter_unpack("<II", table)):
            if k > first and held + plain > self.most:
                ranges.append(_Range(begin, table[8 * first : 8 * k]))
                first, begin, held = k, at, 0
            at, held = at + packed, held + plain
        return [*ranges, _Range(begin, table[8 * first :])]

    def read(self, partition: _Range) -> Iterator:
        import pyarrow as pa

        files, path = _files(self.path)
        codec = pa.Codec("zstd")
        with files.open_input_file(path) as f:
            f.seek(partition.at)
            for packed, plain in struct.iter_unpack("<II", partition.frames):
                lines = codec.decompress(f.read(packed), plain, asbytes=True).split(b"\n")
                told = [x for x in lines if x.startswith(b'{"ruleId":')]
                yield pa.record_batch([pa.array(told, pa.binary()).cast(pa.string())], names=["value"])


class SarifSink(DataSource):
    """``findings.write.format("sarif").mode("overwrite").save(path)``: one SARIF 2.1.0 document.

    A ``path`` that ends in ``.zst`` is compressed, parts too: Zstandard frames of whole results and the seek
    table of its seekable format, so any tool for Zstandard opens it, and tasks read ranges of it.

    Tasks write their results to parts beside ``path``, which the driver and all executors must see; the
    commit puts them together, the driver holding one chunk and the list of rules. If a task fails for good
    nothing is left; options ``tool`` and ``version`` name the tool. A result is one line of the document.
    """

    @classmethod
    def name(cls) -> str:
        return "sarif"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _SarifReader(self.options["path"], int(self.options.get("range", 128 << 20)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if lacking := [c for c in COLUMNS[:4] if c not in schema.names]:
            raise ValueError(f"findings without {', '.join(lacking)}")
        return _SarifWriter(self.options["path"], overwrite, self.options.get("tool", "rampart"), self.options.get("version", "1.0.0"))


# Readers -----------------------------------------------------------------------------------------


@dataclass
class _File(InputPartition):
    path: str
    #: The path below the folder that is read.
    name: str
    value: None = field(default=None)


def _listed(folder: str, globs: str) -> list[_File]:
    """The files below a folder whose names match one of the globs (joined by commas), in path order; a partition each."""
    from pyarrow import fs

    files, at = _files(folder)
    some = [x for x in files.get_file_info(fs.FileSelector(at, recursive=True)) if x.type == fs.FileType.File]
    found = sorted(x.path for x in some if any(fnmatch(x.base_name, g) for g in globs.split(",")))
    return [_File(p, p.removeprefix(at).lstrip("/")) for p in found]


class _Reader(DataSourceReader):
    def __init__(self, folder: str, pattern: str):
        self.folder, self.pattern = folder, pattern

    def partitions(self) -> list[_File]:
        return _listed(self.folder, self.pattern) or [_File("", "")]

    def lines(self, partition: _File) -> Iterator[str]:
        import io

        files, _ = _files(self.folder)
        with files.open_input_stream(partition.path) as f:
            yield from io.TextIOWrapper(f, encoding="utf-8", errors="replace", newline="\n")


class _PackReader(_Reader):
    def __init__(self, folder: str, pattern: str, prompts: bool):
        super().__init__(folder, pattern)
        self.prompts = prompts

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition.path:
            yield from rules_of_text(partition.name, "".join(self.lines(partition)), self.prompts)


class RulePacks(DataSource):
    """``spark.read.format("rulepack").load(folder)``: the rules of a folder's YAML packs, a row a pattern, a partition a file.

    ``reason`` says why a pattern, or a whole file, can't be used; ``rule_packs.read_rule_packs`` parts the rows.
    """

    @classmethod
    def name(cls) -> str:
        return "rulepack"

    def schema(self) -> str:
        return f"file string, {SCHEMA}, reason string"

    def reader(self, schema) -> DataSourceReader:
        return _PackReader(self.options["path"], self.options.get("pattern", "*.yaml,*.yml"), self.options.get("prompts", "true") == "true")


HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")


class _DiffReader(_Reader):
    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        file, line, left = None, 0, 0
        for raw in self.lines(partition):
            text = raw.rstrip("\n")
            hunk = HUNK.match(text)
            if left <= 0 and text.startswith("+++ "):
                file = text[6:].split("\t")[0] if text.startswith("+++ b/") else None
            elif hunk:
                line, left = int(hunk[1]), int(hunk[2]) if hunk[2] is not None else 1
            elif left > 0 and file is not None and text[:1] in ("+", " ", ""):
                yield partition.name, file, line, text.startswith("+"), text[1:]
                line, left = line + 1, left - 1


class UnifiedDiffs(DataSource):
    """``spark.read.format("unidiff").load(folder)``: the lines of new files that hunks show, a partition a diff, read as a stream."""

    @classmethod
    def name(cls) -> str:
        return "unidiff"

    def schema(self) -> str:
        return "diff_id string, file string, line int, added boolean, text string"

    def reader(self, schema) -> DataSourceReader:
        return _DiffReader(self.options["path"], self.options.get("pattern", "*.diff,*.patch"))


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session."""
    for source in (SarifSink, RulePacks, UnifiedDiffs):
        spark.dataSource.register(source)


def read_sarif(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The results, by their schema, of a document that the sink wrote: each is a line, so tasks read ranges of one file."""
    if path.endswith(".zst"):
        register(spark)
        line = spark.read.format("sarif").option("range", spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()).load(path)
    else:
        line = spark.read.option("lineSep", "\n").text(path).where("startswith(value, '{\"ruleId\":')")
    return line.select(F.from_json(F.rtrim("value", F.lit(",")), schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_sarif(findings: DataFrame, path: str, **options: str) -> None:
    """Writes findings as one SARIF document."""
    register(findings.sparkSession)
    findings.select(*(c for c in COLUMNS if c in findings.columns)).write.format("sarif").mode("overwrite").options(**options).save(path)


__all__ = ["RulePacks", "SarifSink", "UnifiedDiffs", "read_sarif", "register", "sarif_result", "unusable", "write_sarif"]
