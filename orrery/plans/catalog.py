"""Tenants, databases and collections, with records in immutable Parquet layers.

The catalog is a small JSON file beside the layers, one a commit with rising numbers; the last one counts,
and making a number that exists fails. A change is made on a copy of the newest state and made again on a
newer one if another writer was first; what a catalog object shows changes only after the commit. A
collection is a base layer and the deltas of later writes, merged when read and made one base when they
outgrow it. A write that meets another one of its collection is made again on what that one left.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.errors import AlreadyExists, InvalidArgument, NotFound
from orrery.functions.values import BUCKETS, METADATA, parse_metadata
from orrery.functions.vectors import parse_vector
from orrery.operators import records as log
from orrery.operators.filters import MapBinding, compile_filter, parse
from orrery.plans import schema as schemas
from orrery.runtime import BROADCAST_ROWS, cut_lineage

DEFAULT_TENANT, DEFAULT_DATABASE, ZERO = "default_tenant", "default_database", "00000000-0000-0000-0000-000000000000"
RECORDS = f"rowid bigint, id string, embedding array<float>, document string, uri string, metadata {METADATA}, seq bigint"
# Fixed value: the largest batch that a server says it takes; a limit only where write() is given it.
MAX_BATCH = 5461
#: Layers of a collection above which they are made one; also done when the deltas' rows outgrow the base.
MAX_LAYERS = 24
#: Catalog files kept; a writer that is so many commits behind loads the newest before it commits.
KEPT = 100


class Files:
    """The few file operations needed, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file; fails if it is there already."""
        stream = self.fs.create(self.path(name), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def names(self, pattern: str) -> list[str]:
        found = self.fs.globStatus(self.path(pattern))
        return sorted(f.getPath().getName() for f in found) if found is not None else []

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _now() -> str:
    return datetime.now(UTC).isoformat()


def batch_of(
    spark: SparkSession, ids: Sequence[str], embeddings: Sequence | None = None, documents: Sequence | None = None, uris: Sequence | None = None,
    metadatas: Sequence | None = None, update: bool = False,
) -> DataFrame:
    """The batch of a request's parallel lists, which must be as long as its ids.

    Embeddings are lists of numbers or base64 texts, metadatas mappings or JSON texts; with update, null
    metadata values delete their keys, else they are refused. What validate() checks comes later.
    """
    log.check_lengths(ids, embeddings, documents, uris, metadatas)

    def of(values: Sequence | None, i: int, read=lambda v: v):
        return None if values is None or values[i] is None else read(values[i])

    def metadata(value) -> dict | None:
        return parse_metadata(value if isinstance(value, str) else json.dumps(value), update)

    rows = [(i, id, of(embeddings, i, parse_vector), of(documents, i), of(uris, i), of(metadatas, i, metadata)) for i, id in enumerate(ids)]  # noqa: A001
    return spark.createDataFrame(rows, f"ord long, id string, embedding array<float>, document string, uri string, metadata {METADATA}")


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self.root = root.rstrip("/")
        self.number, self.state = 0, None
        self.refresh()
        if self.state is None:
            self.reset()

    def refresh(self) -> None:
        """Load the newest commit, if it is not the one at hand."""
        states = self.files.names("catalog-*.json")
        if states and int(states[-1][8:20]) != self.number:
            self.state = json.loads(self.files.read(states[-1]))
            self.number = int(states[-1][8:20])

    def _change(self, change: Callable[[dict], object]):
        """The result of change(state), made on a copy of the newest state and committed; again if another commit came first."""
        while True:
            self.refresh()
            state = copy.deepcopy(self.state)
            result = change(state)
            try:
                self.files.create(f"catalog-{self.number + 1:012d}.json", json.dumps(state))
            except Exception as error:
                if "already exists" not in str(error).lower():
                    raise
                continue
            self.number, self.state = self.number + 1, state
            for old in self.files.names("catalog-*.json")[:-KEPT]:
                self.files.remove(old)
            return result

    def reset(self) -> None:
        old = list((self.state or {}).get("collections", {}))
        empty = {
            "tenants": {DEFAULT_TENANT: {"name": DEFAULT_TENANT, "resource_name": None, "created_at": _now()}},
            "databases": {ZERO: {"id": ZERO, "tenant": DEFAULT_TENANT, "name": DEFAULT_DATABASE, "created_at": _now()}},
            "collections": {},
        }
        self.state = self.state or {}
        self._change(lambda state: (state.clear(), state.update(empty)))
        for id in old:  # noqa: A001
            self.files.remove(id)

    def _sweep(self, dropped: Sequence[dict]) -> None:
        """Remove the layers of dropped collections that no collection, such as a fork, still reads."""
        used = {layer["path"] for c in self.state["collections"].values() for layer in c["layers"]}
        paths = {layer["path"] for c in dropped for layer in c["layers"]}
        paths |= {f"{c['id']}/{name}" for c in dropped for name in self.files.names(f"{c['id']}/*")}
        for path in paths - used:
            self.files.remove(path)
        for id in {path.split("/")[0] for path in paths} | {c["id"] for c in dropped}:  # noqa: A001
            if id not in self.state["collections"] and not self.files.names(f"{id}/*"):
                self.files.remove(id)

    # tenants and databases

    def create_tenant(self, name: str) -> dict:
        schemas.check_tenant(name)

        def change(state: dict) -> dict:
            if name in state["tenants"]:
                raise AlreadyExists(f"Tenant [{name}] already exists")
            return state["tenants"].setdefault(name, {"name": name, "resource_name": None, "created_at": _now()})

        return self._change(change)

    def tenant(self, name: str) -> dict:
        self.refresh()
        if name not in self.state["tenants"]:
            raise NotFound(f"Tenant [{name}] not found")
        return self.state["tenants"][name]

    def update_tenant(self, name: str, resource_name: str) -> dict:
        self.tenant(name)
        return self._change(lambda state: state["tenants"][name].update(resource_name=resource_name)) or self.tenant(name)

    def create_database(self, name: str, tenant: str = DEFAULT_TENANT) -> dict:
        """A database may be made under a tenant that does not exist."""
        schemas.check_database(name)
        made = {"id": str(uuid.uuid4()), "tenant": tenant, "name": name, "created_at": _now()}

        def change(state: dict) -> dict:
            if any(d["tenant"] == tenant and d["name"] == name for d in state["databases"].values()):
                raise AlreadyExists(f"Database [{name}] already exists")
            state["databases"][made["id"]] = made
            return made

        return self._change(change)

    def database(self, name: str = DEFAULT_DATABASE, tenant: str = DEFAULT_TENANT) -> dict:
        self.refresh()
        for d in self.state["databases"].values():
            if (d["tenant"], d["name"]) == (tenant, name):
                return d
        raise NotFound(f"Database [{name}] not found. Are you sure it exists?")

    def database_by_id(self, id: str) -> dict:  # noqa: A002
        self.refresh()
        if id not in self.state["databases"]:
            raise NotFound(f"Database [{id}] not found")
        return self.state["databases"][id]

    def databases(self, tenant: str = DEFAULT_TENANT, limit: int | None = None, offset: int = 0) -> list[dict]:
        self.refresh()
        found = sorted((d for d in self.state["databases"].values() if d["tenant"] == tenant), key=lambda d: d["name"])
        return found[offset : None if limit is None else offset + limit]

    def delete_database(self, name: str, tenant: str = DEFAULT_TENANT) -> None:
        database = self.database(name, tenant)

        def change(state: dict) -> list[dict]:
            state["databases"].pop(database["id"], None)
            return [state["collections"].pop(c["id"]) for c in list(state["collections"].values()) if c["database"] == database["id"]]

        self._sweep(self._change(change))

    # collections

    def create_collection(
        self, name: str, metadata: Mapping | None = None, configuration: Mapping | None = None, schema: Mapping | None = None,
        get_or_create: bool = False, database: str = DEFAULT_DATABASE, tenant: str = DEFAULT_TENANT,
    ) -> Collection:
        schemas.check_name(name)
        if metadata is not None and not metadata:
            raise InvalidArgument("Expected metadata to be a non-empty dict")
        if schema:
            schemas.validate_schema(schema)
        home = self.database(database, tenant)
        made = {
            "id": str(uuid.uuid4()), "database": home["id"], "name": name, "metadata": dict(metadata) if metadata else None,
            "schema": schemas.reconcile(schema, configuration, metadata), "dimension": None, "write_seq": 0, "next_rowid": 1, "version": 0,
            "layers": [], "rows": 0, "streams": {}, "forked_from": None, "created_at": _now(),
        }
        return Collection(self, self._change(lambda state: self._place(state, made, get_or_create)))

    @staticmethod
    def _place(state: dict, made: dict, get_or_create: bool = False) -> str:
        for c in state["collections"].values():
            if (c["database"], c["name"]) == (made["database"], made["name"]):
                if get_or_create:  # as it is: new metadata is ignored
                    return c["id"]
                raise AlreadyExists(f"Collection [{made['name']}] already exists")
        state["collections"][made["id"]] = made
        return made["id"]

    def collections(self, database: str = DEFAULT_DATABASE, tenant: str = DEFAULT_TENANT, limit: int | None = None, offset: int = 0) -> list[Collection]:
        home = self.database(database, tenant)["id"]
        found = sorted(c["id"] for c in self.state["collections"].values() if c["database"] == home)
        return [Collection(self, i) for i in found[offset : None if limit is None else offset + limit]]

    def count_collections(self, database: str = DEFAULT_DATABASE, tenant: str = DEFAULT_TENANT) -> int:
        return len(self.collections(database, tenant))

    def collection(self, name: str, database: str = DEFAULT_DATABASE, tenant: str = DEFAULT_TENANT) -> Collection:
        home = self.database(database, tenant)["id"]
        for c in self.state["collections"].values():
            if (c["database"], c["name"]) == (home, name):
                return Collection(self, c["id"])
        raise NotFound(f"Collection [{name}] does not exist")

    def collection_by_id(self, id: str) -> Collection:  # noqa: A002
        self.refresh()
        if id not in self.state["collections"]:
            raise NotFound(f"Collection [{id}] does not exist")
        return Collection(self, id)

    def collection_by_crn(self, crn: str) -> Collection:
        """tenant resource:database:collection."""
        parts = crn.split(":")
        if len(parts) != 3:
            raise InvalidArgument(f"invalid resource name: {crn}")
        for t in self.state["tenants"].values():
            if t["resource_name"] == parts[0]:
                return self.collection(parts[2], parts[1], t["name"])
        raise NotFound(f"Collection [{crn}] does not exist")

    def delete_collection(self, name: str, database: str = DEFAULT_DATABASE, tenant: str = DEFAULT_TENANT) -> None:
        id = self.collection(name, database, tenant).id  # noqa: A001
        self._sweep(self._change(lambda state: [c for c in [state["collections"].pop(id, None)] if c]))


class Collection:
    def __init__(self, catalog: Catalog, id: str):  # noqa: A002
        self.catalog, self.id = catalog, id

    @property
    def info(self) -> dict:
        """The catalog entry as of the newest commit; read only."""
        self.catalog.refresh()
        return self._entry(self.catalog.state)

    def _entry(self, state: dict) -> dict:
        if self.id not in state["collections"]:
            raise NotFound(f"Collection [{self.id}] does not exist")
        return state["collections"][self.id]

    @property
    def space(self) -> str:
        return self.configuration["hnsw"]["space"]

    @property
    def configuration(self) -> dict:
        return schemas.configuration_of(self.info["schema"])

    def _read(self, path: str) -> DataFrame:
        return self.catalog.spark.read.schema(f"{RECORDS}, gone boolean").parquet(f"{self.catalog.root}/{path}")

    def records(self, info: Mapping | None = None) -> DataFrame:
        """The records as of now; reading them again after a write gives the next state.

        The deltas' last version of each rowid stands for older ones. Their rowids are broadcast only up to
        a size that the catalog counts.
        """
        spark = self.catalog.spark
        layers = (info or self.info)["layers"]
        columns = spark.createDataFrame([], RECORDS).columns
        if not layers:
            return spark.createDataFrame([], RECORDS)
        base = self._read(layers[0]["path"]).select(*columns)
        if len(layers) == 1:
            return base
        deltas = None
        for i, layer in enumerate(layers[1:]):
            part = self._read(layer["path"]).withColumn("__layer", F.lit(i))
            deltas = part if deltas is None else deltas.unionByName(part)
        last = Window.partitionBy("rowid").orderBy(F.col("__layer").desc())
        deltas = deltas.withColumn("__r", F.row_number().over(last)).filter("__r = 1")
        known = deltas.select("rowid")
        if sum(layer["rows"] for layer in layers[1:]) <= BROADCAST_ROWS:
            known = F.broadcast(known)
        return base.join(known, "rowid", "left_anti").select(*columns).unionByName(deltas.filter("not gone").select(*columns))

    def modify(self, name: str | None = None, metadata: Mapping | None = None, configuration: Mapping | None = None) -> None:
        if name is not None:
            schemas.check_name(name)

        def change(state: dict) -> None:
            info = self._entry(state)
            if name is not None:
                if any(c["database"] == info["database"] and c["name"] == name and c["id"] != self.id for c in state["collections"].values()):
                    raise AlreadyExists(f"Collection [{name}] already exists")
                info["name"] = name
            if metadata is not None:
                info["metadata"] = dict(metadata)
            if configuration is not None:
                info["schema"] = schemas.update_configuration(info["schema"], configuration)

        self.catalog._change(change)

    def _lay(self, rows: DataFrame, info: Mapping, update: Callable[[dict], None], base: bool = False) -> bool:
        """Write a layer and commit it with `update`; False, with nothing changed, if the collection was written meanwhile."""
        path = f"{self.id}/{info['version'] + 1}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.catalog.root}/{path}")
        number = self._read(path).count()

        def change(state: dict) -> bool:
            now = self._entry(state)
            if now["version"] != info["version"]:
                return False
            now["version"] += 1
            if base:
                now["layers"] = []
            if number or base:
                now["layers"].append({"path": path, "rows": number})
            update(now)
            return True

        done = self.catalog._change(change)
        if not done or not (number or base):
            self.catalog.files.remove(path)
        return done

    def compact(self) -> None:
        """Make the layers one base. Older ones stay until the collection is deleted: forks and running readers may use them."""
        info = self.info
        if len(info["layers"]) > 1:
            self._lay(self.records(info).withColumn("gone", F.lit(False)), info, lambda now: None, base=True)

    def _compact_if_due(self) -> None:
        layers = self.info["layers"]
        if len(layers) > MAX_LAYERS or sum(layer["rows"] for layer in layers[1:]) > (layers[0]["rows"] if layers else 0):
            self.compact()

    def write(self, op: str, batch: DataFrame, most: int | None = None, stream: tuple[str, int] | None = None) -> int:
        """add, update or upsert of (ord, id, embedding, document, uri, metadata); the number of records touched.

        Only the rows that the batch inserts or changes are written, as a delta. most: the rows that a batch
        may have (such as MAX_BATCH); stream: (query id, batch number), committed together with the rows,
        so that a batch already applied is left out.
        """
        batch = cut_lineage(batch)
        while True:
            info = self.info
            if stream is not None and info["streams"].get(stream[0], -1) >= stream[1]:
                return 0
            dimension = log.validate(batch, info["dimension"], op, most)
            # distinct (key, kind) pairs: as many as the schema has settings
            live = batch.select(F.explode("metadata").alias("k", "v")).filter("v is not null").select("k", F.col("v.kind").alias("kind")).distinct().collect()
            made = cut_lineage(log.changes(self.records(info), batch, op, info["next_rowid"]))
            number, fresh = made.agg(F.count(F.lit(1)), F.count(F.when(F.col("rowid") >= info["next_rowid"], 1))).first()
            seq = info["write_seq"] + number

            def update(now: dict, number=number, fresh=fresh, dimension=dimension, live=live, seq=seq) -> None:
                now["dimension"], now["write_seq"] = dimension, seq
                now["next_rowid"], now["rows"] = now["next_rowid"] + fresh, now["rows"] + fresh
                if number:
                    for row in live:
                        schemas.ensure_key(now["schema"], row.k, BUCKETS[row.kind])
                if stream is not None:
                    now["streams"][stream[0]] = stream[1]

            if self._lay(made.withColumns({"seq": F.lit(seq).cast("long"), "gone": F.lit(False)}), info, update):
                self._compact_if_due()
                return number

    def filtered(self, where=None, where_document=None, ids: Sequence[str] | None = None) -> DataFrame:
        expr = parse(where, where_document)
        schemas.check_indexes(self.info["schema"], expr)
        found = self.records()
        if ids is not None:
            found = log.with_ids(found, ids)
        return found if expr is None else found.filter(compile_filter(expr, MapBinding()))

    def get(self, ids=None, where=None, where_document=None, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Records in insertion order."""
        found = self.filtered(where, where_document, ids).orderBy("rowid")
        found = found.offset(offset) if offset else found
        return found if limit is None else found.limit(limit)

    def query(self, query: Sequence[float], n: int = 10, where=None, where_document=None, ids: Sequence[str] | None = None) -> DataFrame:
        from orrery.operators.knn import knn, restrict_ids

        if ids is not None:
            restrict_ids(self.records(), ids)
        return knn(self.filtered(where, where_document, ids), query, n, self.space, self.info["dimension"])

    def search(self, raw: Mapping) -> DataFrame:
        """One search payload over this collection; see operators.search. Metadata fields come as typed values."""
        from orrery.operators.rank import leaves
        from orrery.operators.search import Collection as Searched
        from orrery.operators.search import parse_payload
        from orrery.operators.sparse import postings

        payload, info, rows = parse_payload(raw), self.info, self.records()
        schemas.check_indexes(info["schema"], payload.filter)
        wanted = {x.key for x in leaves(payload.rank) if x.sparse is not None} if payload.rank else set()
        made, scaled = {}, []
        for key in wanted:
            value = F.try_element_at("metadata", F.lit(key))
            made[key] = postings(rows.select("rowid", F.when(value["kind"] == 5, value["sv"]).alias("sparse")))
            index = ((info["schema"]["keys"].get(key) or {}).get("sparse_vector") or {}).get("sparse_vector_index") or {}
            if (index.get("config") or {}).get("bm25") is True:
                scaled.append(key)
        return Searched(rows, self.space, info["dimension"], made, scaled, MapBinding()).search(payload)

    def delete(self, ids: Sequence[str] | None = None, where=None, where_document=None, limit: int | None = None) -> int:
        """Neither ids nor a filter delete nothing; ids alone report the number asked for. Rows go by a delta of their rowids."""
        expr = parse(where, where_document)
        schemas.check_indexes(self.info["schema"], expr)
        if ids is None and expr is None:
            return 0
        keep = None if expr is None else compile_filter(expr, MapBinding())
        while True:
            info = self.info
            state = self.records(info)
            doomed = cut_lineage(log.doomed(state, ids, keep, limit).select("rowid"))
            number = doomed.count()
            gone = doomed.select("rowid", *(F.lit(None).cast(f.dataType).alias(f.name) for f in state.schema.fields if f.name != "rowid"), F.lit(True).alias("gone"))

            def update(now: dict, number=number) -> None:
                now["rows"] -= number

            if self._lay(gone, info, update):
                self._compact_if_due()
                return len(ids) if expr is None else number

    def count(self) -> int:
        return self.info["rows"]

    def fork(self, name: str) -> Collection:
        """A new collection on the same layers: nothing is copied, and the two part with the next write of either."""
        schemas.check_name(name)
        new = str(uuid.uuid4())

        def change(state: dict) -> str:
            made = copy.deepcopy(self._entry(state)) | {"id": new, "name": name, "streams": {}, "created_at": _now()}
            made["forked_from"] = made["forked_from"] or self.id
            return self.catalog._place(state, made)

        return Collection(self.catalog, self.catalog._change(change))

    def fork_count(self) -> int:
        info = self.info
        root = info["forked_from"] or self.id
        return sum(c["forked_from"] == root for c in self.catalog.state["collections"].values())

    def indexing_status(self) -> dict:
        done = self.info["write_seq"]
        return {"op_indexing_progress": 1.0, "num_unindexed_ops": 0, "num_indexed_ops": done, "total_ops": done}


def fork_counts(collections: DataFrame) -> DataFrame:
    """(collection_id, forks) of a table (collection_id, forked_from): how many forks name each collection as their root."""
    forks = collections.filter("forked_from is not null").groupBy(F.col("forked_from").alias("collection_id")).agg(F.count(F.lit(1)).alias("forks"))
    return collections.select("collection_id").join(forks, "collection_id", "left").fillna(0, ["forks"])


def listing(tenants: DataFrame, collections: DataFrame) -> DataFrame:
    """(tenant, database_name, name) of the collections whose tenant exists."""
    named = tenants.select(F.col("name").alias("tenant"))
    return named.join(collections.select("tenant", "database_name", "name"), "tenant")
