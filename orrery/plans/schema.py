"""Collection schemas: index settings by key and value type, reconciled from what a creator gives."""

from __future__ import annotations

import copy
import ipaddress
import os
import re
from collections.abc import Mapping

from orrery.errors import InvalidArgument, Validation
from orrery.operators.filters import All, Among, Any, Compare, Member, Text

EMBEDDING, DOCUMENT = "#embedding", "#document"
SPACES = ("l2", "ip", "cosine")
# Default index parameters, and the old metadata keys that set them.
HNSW = {"space": "l2", "ef_construction": 100, "ef_search": 100, "max_neighbors": 16, "resize_factor": 1.2, "sync_threshold": 1000, "batch_size": 100}
LEGACY = {
    "hnsw:space": "space", "hnsw:construction_ef": "ef_construction", "hnsw:search_ef": "ef_search", "hnsw:M": "max_neighbors",
    "hnsw:num_threads": "num_threads", "hnsw:resize_factor": "resize_factor", "hnsw:sync_threshold": "sync_threshold", "hnsw:batch_size": "batch_size",
}
# The messages that clients match.
BAD_HNSW = "Failed to parse hnsw parameters from segment metadata"
INDEXES = {"string": "string_inverted_index", "int": "int_inverted_index", "float": "float_inverted_index", "bool": "bool_inverted_index"}


def default_hnsw() -> dict:
    return HNSW | {"num_threads": os.cpu_count() or 1}


def _index(enabled: bool) -> dict:
    return {"enabled": enabled, "config": {}}


def from_hnsw(hnsw: Mapping, embedding_function=None) -> dict:
    """The full schema that an index configuration stands for."""
    inner = {k: v for k, v in hnsw.items() if k != "space"}
    config = {"space": hnsw["space"], "hnsw": inner} | ({"embedding_function": embedding_function} if embedding_function else {})
    defaults = {kind: {name: _index(True)} for kind, name in INDEXES.items()}
    defaults["string"] = {"fts_index": _index(False), "string_inverted_index": _index(True)}
    defaults["float_list"] = {"vector_index": {"enabled": False, "config": copy.deepcopy(config)}}
    defaults["sparse_vector"] = {"sparse_vector_index": {"enabled": False, "config": {"embedding_function": {"type": "unknown"}, "bm25": False}}}
    keys = {
        EMBEDDING: {"float_list": {"vector_index": {"enabled": True, "config": copy.deepcopy(config) | {"source_key": DOCUMENT}}}},
        DOCUMENT: {"string": {"fts_index": _index(True), "string_inverted_index": _index(False)}},
    }
    return {"defaults": defaults, "keys": keys}


def default_schema() -> dict:
    return from_hnsw(default_hnsw())


def from_legacy(metadata: Mapping | None) -> dict:
    """Index parameters out of `hnsw:` metadata keys; any other such key, or a value of the wrong kind, is an error."""
    hnsw = default_hnsw()
    for key, value in (metadata or {}).items():
        if not key.startswith("hnsw:"):
            continue
        name = LEGACY.get(key)
        whole = isinstance(value, int) and not isinstance(value, bool) and value >= 0
        good = value in SPACES if name == "space" else (whole or isinstance(value, float)) if name == "resize_factor" else whole
        if name is None or not good:
            raise InvalidArgument(BAD_HNSW)
        hnsw[name] = float(value) if name == "resize_factor" else value
    if hnsw["sync_threshold"] < 2 or hnsw["batch_size"] < 2:
        raise InvalidArgument(BAD_HNSW)
    return hnsw


def from_configuration(configuration: Mapping | None, metadata: Mapping | None = None) -> tuple[dict, object]:
    """(index parameters, embedding function) of a creation request; old metadata counts where the request says nothing."""
    configuration = configuration or {}
    hnsw, spann, function = (configuration.get(k) for k in ("hnsw", "spann", "embedding_function"))
    if hnsw is not None and spann is not None:
        raise InvalidArgument("Multiple vector index configurations provided")
    if spann is not None:
        return default_hnsw() | ({"space": spann["space"]} if spann.get("space") in SPACES else {}), function
    made = default_hnsw() | {k: v for k, v in (hnsw or {}).items() if v is not None}
    return (from_legacy(metadata) if made == default_hnsw() else made), function


def _overlay(base, own):
    if isinstance(base, Mapping) and isinstance(own, Mapping):
        return {k: _overlay(base.get(k), own[k]) if k in own and own[k] is not None else base[k] for k in (*base, *(k for k in own if k not in base)) if k in base or own[k] is not None}
    return copy.deepcopy(own)


def reconcile(schema: Mapping | None, configuration: Mapping | None, metadata: Mapping | None = None) -> dict:
    """One schema of the three things a creator may give; a schema and a configuration together are an error."""
    hnsw, function = from_configuration(configuration, metadata)
    plain = hnsw == default_hnsw()
    merged = _overlay(default_schema(), schema) if schema else default_schema()
    own = merged != default_schema()
    if own and not (plain and not function):
        raise InvalidArgument("Failed to reconcile schema: Cannot set both collection config and schema simultaneously")
    return merged if own else from_hnsw(hnsw, function)


def configuration_of(schema: Mapping) -> dict:
    """The configuration that a schema amounts to, derived anew on each read."""
    config = schema["keys"][EMBEDDING]["float_list"]["vector_index"]["config"]
    hnsw = {k: v for k, v in config.get("hnsw", {}).items() if k not in ("num_threads", "batch_size")}
    return {"hnsw": {"space": config["space"]} | hnsw, "spann": None, "embedding_function": config.get("embedding_function")}


def update_configuration(schema: Mapping, update: Mapping) -> dict:
    """The schema with changed index parameters; only those that may change later, the space stays."""
    made = copy.deepcopy(schema)
    change = {k: v for k, v in (update.get("hnsw") or {}).items() if k not in ("space", "ef_construction", "max_neighbors") and v is not None}
    for holder in (made["defaults"], made["keys"][EMBEDDING]):
        config = holder["float_list"]["vector_index"]["config"]
        config.setdefault("hnsw", {}).update(change)
        if update.get("embedding_function"):
            config["embedding_function"] = update["embedding_function"]
    return made


def ensure_key(schema: dict, key: str, kind: str) -> bool:
    """Gives a key seen with a kind that kind's default settings; whether the schema changed."""
    if key.startswith("#") or kind not in schema["defaults"]:
        return False
    own = schema["keys"].setdefault(key, {})
    if kind in own:
        return False
    own[kind] = copy.deepcopy(schema["defaults"][kind])
    return True


def _on(holder: Mapping | None, kind: str, index: str) -> bool:
    return bool((((holder or {}).get(kind) or {}).get(index) or {}).get("enabled"))


def validate_schema(schema: Mapping) -> None:
    """The rules for a schema that a user gives, in order."""

    def fail(message: str):
        raise Validation("schema", message)

    defaults = schema.get("defaults") or {}
    if _on(defaults, "float_list", "vector_index"):
        fail("Vector index cannot be enabled by default. It can only be enabled on #embedding field.")
    if _on(defaults, "sparse_vector", "sparse_vector_index"):
        fail("Sparse vector index cannot be enabled by default. Please enable sparse vector index on specific keys.")
    if _on(defaults, "string", "fts_index"):
        fail("Full text search / regular expression index cannot be enabled by default. It can only be enabled on #document field.")
    for key, own in (schema.get("keys") or {}).items():
        own = own or {}
        if key.startswith("#") and key not in (EMBEDDING, DOCUMENT):
            fail(f"key cannot begin with '#'. Keys starting with '#' are reserved for system use: {key}")
        if key == DOCUMENT and set(own) - {"string"}:
            fail(f"Document field cannot have any value types other than string: {key}")
        if key == EMBEDDING and set(own) - {"float_list"}:
            fail(f"Embedding field cannot have any value types other than float_list: {key}")
        if key != EMBEDDING and _on(own, "float_list", "vector_index"):
            fail(f"Vector index can only be enabled on #embedding field: {key}")
        source = (((own.get("float_list") or {}).get("vector_index") or {}).get("config") or {}).get("source_key")
        if key == EMBEDDING and source not in (None, DOCUMENT):
            fail("Vector index can only source from #document")
        if key != DOCUMENT and _on(own, "string", "fts_index"):
            fail(f"Full text search / regular expression index can only be enabled on #document field: {key}")
        if key == DOCUMENT and _on(own, "string", "string_inverted_index"):
            fail(f"String inverted index can not be enabled on #document key: {key}")


def check_indexes(schema: Mapping, expr) -> None:
    """Refuses a filter on a key and type whose index is off, or on documents without full-text search."""
    if isinstance(expr, (All, Any)):
        for child in expr.children:
            check_indexes(schema, child)
    elif isinstance(expr, Text):
        own = ((schema["keys"].get(DOCUMENT) or {}).get("string") or {}).get("fts_index") or (schema["defaults"].get("string") or {}).get("fts_index")
        if own is not None and not own["enabled"]:
            raise InvalidArgument("Cannot filter using full-text search because FTS indexing is disabled")
    elif isinstance(expr, (Compare, Member, Among)):
        value = expr.values[0] if isinstance(expr, Among) else expr.value
        kind = "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "float" if isinstance(value, float) else "string"
        own = (schema["keys"].get(expr.key) or {}).get(kind) or schema["defaults"].get(kind) or {}
        index = own.get(INDEXES[kind])
        if index is not None and not index["enabled"]:
            shown = {"bool": "Bool", "int": "Int", "float": "Float", "string": "Str"}[kind]
            raise InvalidArgument(f"Cannot filter using metadata key '{expr.key}' with type '{shown}' because indexing is disabled")


def index_plan(dimension: int, hnsw: Mapping) -> dict | None:
    """The vector index that would be built: none above 4,000 dimensions, 16-bit vectors above 2,000, parameters in their ranges."""
    if dimension > 4000:
        return None
    m = min(max(int(hnsw["max_neighbors"]), 2), 100)
    return {"type": "halfvec" if dimension > 2000 else "vector", "m": m, "ef_construction": min(max(int(hnsw["ef_construction"]), 4, 2 * m), 1000)}


_NAME = re.compile(r"[a-zA-Z0-9][a-zA-Z0-9._-]{1,510}[a-zA-Z0-9]")


def check_name(name: str) -> None:
    """Names of collections and databases; one `+` parts a topology off."""
    if "+" in name:
        if len(name) > 512:
            raise Validation("name", f"Expected a name containing 3-512 characters. Got: {len(name)}")
        topology, _, rest = name.partition("+")
        if "+" in rest:
            raise Validation("name", "Expected a name to contain at most one topology:  Got two `+` characters.")
        check_name(topology)
        check_name(rest)
        return
    if not _NAME.fullmatch(name):
        raise Validation("name", f"Expected a name containing 3-512 characters from [a-zA-Z0-9._-], starting and ending with a character in [a-zA-Z0-9]. Got: {name}")
    if ".." in name:
        raise Validation("name", f"Expected a name that does not contains two consecutive periods (..). Got {name}")
    try:
        ipaddress.ip_address(name)
    except ValueError:
        return
    raise Validation("name", f"Expected a name that is not a valid ip address. Got {name}")


def check_database(name: str) -> None:
    """As check_name(), but a database's message comes without the field's name."""
    try:
        check_name(name)
    except Validation as error:
        raise InvalidArgument(str(error).removeprefix("Validation error: name: ")) from None


def check_tenant(name: str) -> None:
    if len(name) < 3:
        raise Validation("name", f'Validation error: length [{{"min": Number(3), "value": String("{name}")}}]')
