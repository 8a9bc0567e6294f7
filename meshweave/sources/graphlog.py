"""Graph logs, JSON documents of a whole graph, as a Spark data source.

spark.read.format("graph_log").load(path) gives rows (kind, src, dst, weight): `node` with
its id as src, `arc`, and `flag` with its name as src and 0 or 1 as weight. The document is
read a piece at a time and rows are passed on as they come, so a task holds a piece of
text and a batch of rows, however large the file; a folder is one document, its files in
order of their names. Paths are those of pyarrow's file systems.

Layouts: {"nodes": {id: {id: weight}}, "directed": .., "weighted": ..}, and the older ones
of flags in place of weights: three lines (nodes, adjacency, whether undirected), an array
of these three, or an object of them under other names.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "kind string, src string, dst string, weight double"
#: The names that older layouts give to the parts of a graph.
NODE_KEYS = ("nodes", "V", "node_map")
EDGE_KEYS = ("adj", "E", "adjacency", "edge_map")
BOTH_WAYS_KEYS = ("is_bidirectional", "bidirectional", "undirected")
FLAGS = ("directed", "weighted", *BOTH_WAYS_KEYS)
PIECE, ROWS = 1 << 20, 8192
_token = re.compile(r'[\s,:]*(?:([{}\[\]])|"([^"\\]*(?:\\.[^"\\]*)*)"|([^\s,:{}\[\]"]+))', re.S)


class Broken(ValueError):
    """Text that is no document of a known layout."""


def tokens(pieces: Iterable[str]) -> Iterator[tuple[str, Any]]:
    """(mark, None) of brackets, ("text", str) and ("value", of a number or a name)."""
    held, source, more = "", iter(pieces), True
    while True:
        at = 0
        while (m := _token.match(held, at)) and (m.end() < len(held) or not more):
            at = m.end()
            if m[1]:
                yield m[1], None
            elif m[3] is not None:
                try:
                    yield "value", json.loads(m[3])
                except ValueError:
                    raise Broken(f"not JSON: {m[3][:40]}") from None
            else:
                yield "text", json.loads(f'"{m[2]}"', strict=False) if "\\" in m[2] else m[2]
        held = held[at:]
        if not more:
            if held.strip(" \t\r\n,:"):
                raise Broken(f"not JSON: {held[:40]}")
            return
        piece = next(source, None)
        more = piece is not None
        held += piece or ""


def leaves(read: Iterator[tuple[str, Any]]) -> Iterator[tuple[tuple, Any]]:
    """(path, value) of every value, and (path, {}) where an object begins. A path starts
    with the number of the document and goes on with keys, or numbers in arrays."""
    path: list = [0]
    inside: list[str] = []
    key = False
    for kind, value in read:
        if kind in "}]" and len(kind) == 1:
            if not inside or inside.pop() != {"}": "{", "]": "["}[kind]:
                raise Broken("brackets do not match")
            path.pop()
        elif inside and inside[-1] == "{" and not key:
            if kind != "text":
                raise Broken("a key is missing")
            path[-1], key = value, True
            continue
        elif kind in ("{", "["):
            if kind == "{":
                yield tuple(path), {}
            inside.append(kind)
            path.append(None if kind == "{" else 0)
            key = False
            continue
        else:
            yield tuple(path), value
        key = False
        if not inside or inside[-1] == "[":
            path[-1] += 1
    if inside:
        raise Broken("the document ends too soon")


def _true(x: Any) -> bool:
    return x.strip().lower() in {"1", "t", "true", "yes", "y"} if isinstance(x, str) else bool(x)


def rows(found: Iterator[tuple[tuple, Any]]) -> Iterator[tuple[str, str, str | None, float | None]]:
    """Rows of SCHEMA from the leaves of a document in any of the layouts."""
    parts = dict.fromkeys(NODE_KEYS, 0) | dict.fromkeys(EDGE_KEYS, 1)
    lines: bool | None = None  # whether the layout is that of three lines; None: not known yet
    held: list[tuple[str, Any]] = []  # what is a flag or an id, as the layout will tell
    for (doc, *path), value in found:
        if doc > 0 and lines is None:  # a second document: three lines, whatever the ids
            lines = True
            for p, v in held:
                yield from _of(0, [p], v)
            held = []
        if not path:
            if lines and doc == 2 and not isinstance(value, dict):
                yield "flag", "undirected", None, float(_true(value))
            continue
        if isinstance(path[0], int):  # an array of three
            part, path = path[0], path[1:]
            if part == 2 and not path:
                yield "flag", "undirected", None, float(_true(value))
                continue
        elif lines or (lines is None and len(path) == 1 and path[0] not in FLAGS and not isinstance(value, dict)):
            if not lines:  # ids right under the first document: three lines
                lines = True
                for p, v in held:
                    yield from _of(0, [p], v)
                held = []
            part = doc
        elif len(path) == 1 and path[0] in FLAGS and not isinstance(value, dict):
            if lines is None:
                held.append((path[0], value))
            else:
                yield "flag", path[0], None, float(_true(value))
            continue
        elif path[0] in parts:
            if lines is None:
                lines = False
                for p, v in held:
                    yield "flag", p, None, float(_true(v))
                held = []
            part, path = parts[path[0]], path[1:]
        else:
            continue
        yield from _of(part, path, value)
    if lines is None:
        for p, v in held:
            yield "flag", p, None, float(_true(v))


def _of(part: int, path: list, value: Any) -> Iterator[tuple[str, str, str | None, float | None]]:
    if part == 0 and len(path) == 1 and (isinstance(value, dict) or _true(value)):
        yield "node", path[0], None, None
    elif part in (0, 1) and len(path) == 2 and not isinstance(value, dict) and (not isinstance(value, bool) or value):
        yield "arc", path[0], path[1], float(value)


def files_of(path: str) -> list[tuple[str, str]]:
    """(file system's URI or path) of the document's files, in order."""
    system, inner = fs.FileSystem.from_uri(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, inner)]
    inside = [f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return [(path, f) for f in sorted(inside)]


def pieces(files: list[tuple[str, str]]) -> Iterator[str]:
    decode = codecs.getincrementaldecoder("utf-8")()
    for uri, inner in files:
        with fs.FileSystem.from_uri(uri)[0].open_input_stream(inner) as stream:
            while data := stream.read(PIECE):
                yield decode.decode(data)


class Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(files_of(self.path))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("kind", pa.string()), ("src", pa.string()), ("dst", pa.string()), ("weight", pa.float64())])
        held: list[tuple] = []
        for row in rows(leaves(tokens(pieces(partition.value)))):
            held.append(row)
            if len(held) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)


class GraphLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "graph_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> Reader:
        return Reader(self.options["path"])
