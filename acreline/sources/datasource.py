"""The listing store as a data source: selections are pushed to the store, rows are written in batches with retry and probe.

A store is reached by a client, a class named by the option client (module:Class, by default FolderClient) that gets the
options. It has parts(), the names of what can be read apart; rows(part, formula, wanted), which yields dicts; find(urls),
those of urls that are stored; and create(rows), which raises Transient if nothing was stored and may be tried again, and
Unclear if that is not known. Formula and wanted say the same: the store's own text, and a list of (field, kind, value).
A client may also have groups(), lists of parts that one task reads, and batches(part, formula, wanted, schema), the rows as
Arrow batches of a schema.

A lookup costs a pass over what is stored where the store has no index, so append() tells new rows from stored ones by one
join, and its writer looks up only what a task that runs again may have created before.
"""

from __future__ import annotations

import importlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.types import Row, StructType


class Transient(Exception):
    """Nothing was stored; the batch may be sent again."""


class Unclear(Exception):
    """The batch may have been stored in part or whole."""


def quoted(value: object) -> str:
    """A value in a formula: numbers plain, texts in single quotes with quotes and backslashes escaped, as lines."""
    if isinstance(value, bool):
        return "TRUE()" if value else "FALSE()"
    if isinstance(value, (int, float)):
        return repr(value)
    text = str(value).replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f"'{text}'"


#: How a formula says each kind of selection; the store compares an empty field as unequal to any text.
SAYS = {
    "=": "{f} = {v}",
    "<>": "{f} != {v}",
    ">": "{f} > {v}",
    ">=": "{f} >= {v}",
    "<": "{f} < {v}",
    "<=": "{f} <= {v}",
    "in": "OR({each})",
    "starts": "LEFT({f}, {n}) = {v}",
    "set": "NOT({f} = BLANK())",
    "unset": "{f} = BLANK()",
}


def formula(wanted: list[tuple[str, str, object]]) -> str:
    """The store's text of all selections of wanted together; empty for none."""
    said = []
    for field, kind, value in wanted:
        f = f"{{{field}}}"
        each = ", ".join(f"{f} = {quoted(v)}" for v in value) if kind == "in" else ""
        said.append(SAYS[kind].format(f=f, v=quoted(value), n=len(value) if kind == "starts" else 0, each=each))
    return f"AND({', '.join(said)})" if len(said) > 1 else "".join(said)


def selection(f: D.Filter) -> tuple[str, str, object] | None:
    """(field, kind, value) of a filter of Spark that the store can answer alone, else None."""
    if isinstance(f, D.IsNotNull):
        return f.attribute[0], "set", None
    if isinstance(f, D.IsNull):
        return f.attribute[0], "unset", None
    if isinstance(f, D.In) and all(v is not None for v in f.value):
        return f.attribute[0], "in", tuple(f.value)
    if isinstance(f, D.StringStartsWith):
        return f.attribute[0], "starts", f.value
    # a null-safe inequality keeps empty fields, as the store does; a plain one would drop them
    if isinstance(f, D.Not) and isinstance(f.child, D.EqualNullSafe) and f.child.value is not None:
        return f.child.attribute[0], "<>", f.child.value
    kinds = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}
    kind = kinds.get(type(f)) or ("=" if isinstance(f, D.EqualNullSafe) and f.value is not None else None)
    return (f.attribute[0], kind, f.value) if kind and len(f.attribute) == 1 else None


#: Bytes of stored files that one task reads; a store of many small batches is not a task each.
GROUP_BYTES = 32 << 20


class FolderClient:
    """A store of Parquet files in a folder that all machines share; a file is a part, and so is each batch's own file."""

    def __init__(self, options: dict[str, str]):
        from pyarrow import fs

        path = options["path"]
        self.files, self.path = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.url = options.get("key", "url")

    def dataset(self, parts: list[str]):
        import pyarrow.dataset as ds

        return ds.dataset(parts, filesystem=self.files, format="parquet")

    def sizes(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        found = self.files.get_file_info(fs.FileSelector(self.path, recursive=True, allow_not_found=True))
        return sorted((f.path, f.size) for f in found if f.is_file and f.size and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")))

    def parts(self) -> list[str]:
        return [p for p, _ in self.sizes()]

    def groups(self) -> list[list[str]]:
        """The parts in lists of GROUP_BYTES together, a larger one alone."""
        out, held = [], GROUP_BYTES
        for part, size in self.sizes():
            if held + size > GROUP_BYTES:
                out.append([])
                held = 0
            out[-1].append(part)
            held += size
        return out

    def selected(self, part: str, wanted: list, columns: list[str] | None = None) -> Iterator:
        """Arrow batches of a part's rows, with all its columns or those of columns that it has."""
        import pyarrow as pa
        import pyarrow.compute as pc

        tests = {
            "=": lambda c, v: c == v,
            "<>": lambda c, v: (c != v) | c.is_null(),
            ">": lambda c, v: c > v,
            ">=": lambda c, v: c >= v,
            "<": lambda c, v: c < v,
            "<=": lambda c, v: c <= v,
            "in": lambda c, v: c.isin(list(v)),
            "starts": lambda c, v: pc.starts_with(c, v),
            "set": lambda c, v: c.is_valid(),
            "unset": lambda c, v: c.is_null(),
        }
        keep = None
        for field, kind, value in wanted:
            own = tests[kind](pc.field(field), value)
            keep = own if keep is None else keep & own
        d = self.dataset([part])
        some = columns if columns is None else [c for c in columns if c in d.schema.names]
        for batch in d.to_batches(columns=some, filter=keep, batch_size=4096):
            # files may hold times in nanoseconds or without a zone, which then is UTC
            whole = {f.name: pa.timestamp("us", "UTC") if pa.types.is_timestamp(f.type) else f.type for f in batch.schema}
            yield batch.cast(pa.schema(whole.items()))

    def rows(self, part: str, formula: str, wanted: list) -> Iterator[dict]:
        for batch in self.selected(part, wanted):
            yield from batch.to_pylist()

    def batches(self, part: str, formula: str, wanted: list, schema) -> Iterator:
        import pyarrow as pa

        for batch in self.selected(part, wanted, schema.names):
            have = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            cols = [have[f.name].cast(f.type) if f.name in have else pa.nulls(batch.num_rows, f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    def find(self, urls: list[str]) -> set[str]:
        import pyarrow.dataset as ds

        if not (parts := self.parts()):
            return set()
        return set(self.dataset(parts).to_table(columns=[self.url], filter=ds.field(self.url).isin(urls))[self.url].to_pylist())

    def create(self, rows: list[dict]) -> None:
        import pyarrow as pa
        import pyarrow.parquet as pq

        self.files.create_dir(self.path, recursive=True)
        own = f"{self.path}/.{uuid.uuid4().hex}"
        # Spark gives times without a zone, in the worker's own
        aware = lambda v: v.astimezone(UTC) if isinstance(v, datetime) else v
        pq.write_table(pa.Table.from_pylist([{k: aware(v) for k, v in r.items()} for r in rows]), own, filesystem=self.files)
        self.files.move(own, f"{self.path}/batch-{uuid.uuid4().hex}.parquet")


def client(options: dict[str, str]):
    module, _, name = options.get("client", f"{__name__}:FolderClient").partition(":")
    return getattr(importlib.import_module(module), name)(options)


class StoreReader(D.DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.names, self.options, self.wanted = schema, schema.names, options, []

    def pushFilters(self, filters):
        for f in filters:
            if found := selection(f):
                self.wanted.append(found)
            else:
                yield f

    def partitions(self):
        store = client(self.options)
        groups = store.groups() if hasattr(store, "groups") else [[p] for p in store.parts()]
        return [D.InputPartition(g) for g in groups] or [D.InputPartition([])]

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        store, said = client(self.options), formula(self.wanted)
        for part in partition.value:
            if hasattr(store, "batches"):
                yield from store.batches(part, said, self.wanted, to_arrow_schema(self.schema))
            else:
                for r in store.rows(part, said, self.wanted):
                    yield tuple(r.get(c) for c in self.names)


@dataclass
class Written(D.WriterCommitMessage):
    part: int
    created: int
    found: int
    failed: str | None


class StoreWriter(D.DataSourceWriter):
    """Options: batch (10 rows), waits (seconds before each new try, "5,15"), failed (a folder of the batches that failed), new.

    With new ("true", see append) no row was stored when the job began and no key comes twice, so the first attempt of a
    task sends its batches without a lookup. It leaves a mark below failed, by which any later one knows to look up.
    """

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.options, self.key, self.job = options, options.get("key", "url"), uuid.uuid4().hex
        self.size, self.waits = int(options.get("batch", "10")), [float(x) for x in options.get("waits", "5,15").split(",") if x]

    def sent(self, store, rows: list[dict]) -> tuple[int, bool]:
        """(created, whether all are stored). What an unclear answer left open is looked up before anything is sent again."""
        left, created = rows, 0
        for wait in [*self.waits, None]:
            try:
                store.create(left)
                return created + len(left), True
            except Transient:
                pass
            except Unclear:
                have = store.find([r[self.key] for r in left])
                created, left = created + sum(r[self.key] in have for r in left), [r for r in left if r[self.key] not in have]
                if not left:
                    return created, True
            if wait is not None:
                time.sleep(wait)
        return created, False

    def write(self, iterator: Iterator[Row]) -> Written:
        context, store = TaskContext.get(), client(self.options)
        part, created, found, failed, seen = context.partitionId(), 0, 0, [], set()
        held: list[dict] = []
        new = self.new() and not self.begun(part)

        def flush():
            nonlocal created, found, held
            # a task that runs again, or a row that comes again, finds what is there
            have = set() if new else store.find([r[self.key] for r in held])
            rows = [r for r in held if r[self.key] not in have]
            found += len(held) - len(rows)
            if rows:
                n, ok = self.sent(store, rows)
                created += n
                if not ok:
                    failed.extend(rows)
            held = []

        for row in iterator:
            if row[self.key] in seen:
                found += 1
                continue
            held.append(row.asDict(recursive=True))
            seen.add(row[self.key])
            if len(held) == self.size:
                flush()
                seen.clear()
        if held:
            flush()
        return Written(part, created, found, self.set_aside(failed, part, context.taskAttemptId()) if failed else None)

    def new(self) -> bool:
        return self.options.get("new", "false").lower() == "true"

    def marks(self):
        """The file system and folder of the marks of this job's tasks."""
        files, path = self.failed_folder()
        return files, f"{path}/_begun-{self.job}"

    def begun(self, part: int) -> bool:
        """Whether an attempt of the task has begun before; from now on one has. Attempt numbers begin anew with a stage's."""
        from pyarrow import fs

        files, path = self.marks()
        before = files.get_file_info(f"{path}/{part}").type != fs.FileType.NotFound
        files.create_dir(path, recursive=True)
        files.open_output_stream(f"{path}/{part}").close()
        return before

    def clear(self) -> None:
        if self.new():
            from pyarrow import fs

            files, path = self.marks()
            if files.get_file_info(path).type != fs.FileType.NotFound:
                files.delete_dir(path)

    def set_aside(self, rows: list[dict], part: int, attempt: int) -> str:
        """Failed rows as JSON lines, under a name of this attempt that no reader takes before the commit."""
        files, path = self.failed_folder()
        files.create_dir(path, recursive=True)
        name = f"{path}/_{part:06d}-{attempt}-{uuid.uuid4().hex}.jsonl"
        with files.open_output_stream(name) as f:
            f.write("".join(json.dumps(r, default=str) + "\n" for r in rows).encode())
        return name

    def failed_folder(self):
        from pyarrow import fs

        path = self.options.get("failed", "")
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def commit(self, messages: list[Written | None]) -> None:
        self.clear()
        for m in messages:
            if m and m.failed:
                folder, _, name = m.failed.rpartition("/")
                self.failed_folder()[0].move(m.failed, f"{folder}/{name[1:]}")

    def abort(self, messages: list[Written | None]) -> None:
        """What was created stays, as a next run finds it; what was set aside goes."""
        self.clear()
        for m in messages:
            if m and m.failed:
                self.failed_folder()[0].delete_file(m.failed)


class ListingStore(D.DataSource):
    """spark.read / write.format("listing_store") after register(spark)."""

    @classmethod
    def name(cls) -> str:
        return "listing_store"

    def reader(self, schema: StructType) -> StoreReader:
        return StoreReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> StoreWriter:
        if overwrite:
            raise ValueError("the store is only appended to")
        return StoreWriter(schema, dict(self.options))


def register(spark) -> None:
    """Makes listing_store known to the session and lets Spark push filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ListingStore)


def load(spark, path: str, schema: str | StructType, **options: str):
    """The rows of a store, for one selection.

    Load anew for each selection: Spark 4.1 keeps what was pushed with the DataFrame that was loaded, so a second selection
    on the same one of which nothing can be pushed would still be answered by the first.
    """
    register(spark)
    return spark.read.format("listing_store").schema(schema).options(**options).load(path)


def append(rows: DataFrame, path: str, tasks: int, key: str = "url", **options: str | int) -> None:
    """Creates the rows whose key the store lacks, the first of each key, by so many tasks at a time.

    Stored keys are read once and joined, whatever the number of rows and batches; then they are sent as by the writer.
    """
    register(rows.sparkSession)
    stored = load(rows.sparkSession, path, StructType([rows.schema[key]]), key=key, **{k: v for k, v in options.items() if k == "client"}).withColumnRenamed(key, "_stored")
    new = rows.join(stored, F.col(key).eqNullSafe(F.col("_stored")), "left_anti").repartition(tasks, key).dropDuplicates([key])
    new.write.format("listing_store").mode("append").options(key=key, new="true", **options).save(path)
