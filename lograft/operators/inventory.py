"""Fleet inventory: effective settings, registry checks and admission of discovered devices."""

from __future__ import annotations

import functools
import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lograft import fixed
from lograft.functions import text
from lograft.operators.filters import discovery_match
from lograft.plans.salted import salted_join
from lograft.session import shared_dir, ship

SETTINGS = tuple(fixed.BUILTIN_SETTINGS)
BACKENDS = ("auto", "cli", "api")


def effective_settings(registry: DataFrame, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Device value over default value over built-in value, field by field."""
    given = dict(defaults or {})

    def setting(name: str) -> Column:
        kind = registry.schema[name].dataType
        levels = [F.col(name), F.lit(given.get(name)).cast(kind), F.lit(fixed.BUILTIN_SETTINGS[name]).cast(kind)]
        return F.coalesce(*levels).alias(name)

    merged = registry.withColumn("backend", F.coalesce("backend", F.lit(given.get("backend")).cast("string")))
    return merged.select(*[setting(c) if c in SETTINGS else F.col(c) for c in merged.columns])


#: An object with these keys only names where a value is kept; it replaces what stands below it as a whole.
REFERENCE_KEYS = ("env", "file")


def _default_leaves(value: object, path: tuple[str, ...] = ()) -> list[tuple[list[str], str]]:
    if isinstance(value, Mapping) and value:
        return [leaf for k, v in value.items() for leaf in _default_leaves(v, (*path, k))]
    return [(list(path), json.dumps(value, ensure_ascii=False, separators=(",", ":")))]


def document_leaves(documents: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, value): whatever in a JSON document is no object, is an empty one, or only refers to a value; values as JSON text.

    One level is opened at a time, for all documents at once. A text that is no JSON counts as an empty object.
    """
    empty = F.parse_json(F.lit("{}"))
    opened = documents.select(key, F.array().cast("array<string>").alias("path"), F.coalesce(F.try_parse_json(F.col(document)), empty).alias("value"))
    found = []
    while True:
        entries = F.when(F.startswith(F.schema_of_variant("value"), F.lit("OBJECT<")), F.try_variant_get("value", "$", "map<string,variant>"))
        level = opened.withColumn("entries", entries)
        keys = F.map_keys("entries")
        inner = F.coalesce((F.size(keys) > 0) & ((F.size("path") == 0) | F.exists(keys, lambda k: ~k.isin(*REFERENCE_KEYS))), F.lit(False))
        found.append(level.filter(~inner).select(key, "path", F.coalesce(F.to_json("value"), F.lit("null")).alias("value")))
        below = level.filter(inner).select(key, "path", F.explode("entries").alias("name", "inner"))
        opened = below.select(key, F.concat("path", F.array("name")).alias("path"), F.col("inner").alias("value"))
        if opened.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)


def nested_settings(documents: DataFrame, defaults: Mapping[str, object], key: str = "pos", document: str = "settings") -> DataFrame:
    """(key, path, value): every document laid over the defaults. Objects merge key by key, all else replaces what stands at its place, also null.

    An empty object changes no default object; a reference replaces a default as a whole. ``key`` names one document.
    """
    given = F.array(*[F.struct(F.array(*map(F.lit, p)).cast("array<string>").alias("path"), F.lit(v).alias("value")) for p, v in _default_leaves(defaults)])
    own = document_leaves(documents, key, document).groupBy(key).agg(F.collect_list(F.struct("path", "value")).alias("own"))
    under = lambda long, short: (F.size(long) > F.size(short)) & (F.slice(long, F.lit(1), F.size(short)) == short)
    blank = F.lit("{}")
    kept = F.filter(given, lambda d: ~F.exists("own", lambda o: (
        (o["path"] == d["path"]) | under(o["path"], d["path"]) | (under(d["path"], o["path"]) & (o["value"] != blank)))
        & ~((o["path"] == d["path"]) & (o["value"] == blank) & (d["value"] == blank))))
    said = F.filter("own", lambda o: (o["value"] != blank) | ~F.exists(given, lambda d: under(d["path"], o["path"]) | (d["path"] == o["path"]) & (d["value"] == blank)))
    merged = own.select(key, F.explode(F.concat(said, kept)).alias("leaf"))
    return merged.select(key, F.array_join("leaf.path", ".").alias("path"), F.col("leaf.value").alias("value"))


def resolve_backend(registry: DataFrame) -> DataFrame:
    """``auto`` means cli with a configuration file, else api; the target is address or alias."""
    named = F.when(F.col("backend").isin("cli", "api"), F.col("backend"))
    chosen = F.coalesce(named, F.when(F.coalesce("config_file", F.lit("")) != "", F.lit("cli")).otherwise(F.lit("api")))
    target = F.coalesce("address", F.concat(F.col("alias"), F.lit(".local")))
    return registry.withColumn("backend", chosen).withColumn("target", target)


def is_address(value: Column) -> Column:
    """An IPv4 or IPv6 address (brackets allowed) or a host name."""
    bare = F.regexp_replace(value, r"^[\[\]]+|[\[\]]+$", "")
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    v4 = rf"{octet}(\.{octet}){{3}}"
    body = F.regexp_replace(bare, "%[^%]+$", "")  # a zone such as %eth0
    parts = F.filter(F.split(body, ":"), lambda p: p != "")
    with_v4 = F.rlike(body, F.lit(rf"(^|:){v4}$"))
    groups = F.size(parts) + F.when(with_v4, 1).otherwise(0)
    shape = F.rlike(body, F.lit(rf"^([0-9A-Fa-f]{{1,4}}|:)*({v4})?$")) & ~F.rlike(body, F.lit("[0-9A-Fa-f]{5}"))
    runs = F.size(F.split(body, "::")) - 1
    colons = F.contains(body, F.lit(":")) & ~F.rlike(body, F.lit("^:[^:]|[^:]:$|:::"))
    v6 = shape & colons & F.when(runs == 1, groups <= 7).otherwise((runs == 0) & (groups == 8))
    return F.rlike(bare, F.lit(f"^{v4}$")) | v6 | F.rlike(value, F.lit(fixed.HOST_NAME))


def first_of_name(registry: DataFrame) -> DataFrame:
    """Position of the first valid device per name, case ignored."""
    return registry.filter(text.valid_device_name(F.col("name"))).groupBy(F.lower("name").alias("_low")).agg(
        F.min("pos").alias("_first")
    )


def duplicate_names(registry: DataFrame) -> DataFrame:
    """Rows whose name an earlier row already has; the first one wins.

    One pre-aggregated row per name is joined back, salted because very many rows may share a name.
    """
    named = registry.filter(text.valid_device_name(F.col("name"))).withColumn("_low", F.lower("name"))
    return salted_join(named, first_of_name(registry), ["_low"]).filter(F.col("pos") > F.col("_first")).select(
        "pos", "name", F.col("_first").alias("first_pos")
    )


def violations(registry: DataFrame) -> DataFrame:
    """Every problem of every row: (pos, name, field, problem). Settings must be merged already.

    A value out of range is reported and then taken as its built-in default, so a later rule does
    not report it twice.
    """
    def bad(name: str, condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).alias(name)

    c = F.col
    out = {
        "retry_initial_delay": c("retry_initial_delay") < 0.1, "retry_max_delay": c("retry_max_delay") < 0.1,
        "retry_multiplier": c("retry_multiplier") < 1, "retry_jitter": ~c("retry_jitter").between(0, 1),
        "retry_reset_after": c("retry_reset_after") < 0, "idle_timeout": c("idle_timeout") < 0,
        "api_port": ~c("api_port").between(1, 65535), "api_connect_timeout": c("api_connect_timeout") <= 0,
    }
    used = lambda n: F.when(out[n], F.lit(fixed.BUILTIN_SETTINGS[n])).otherwise(c(n))
    blank = lambda n: F.trim(c(n)) == ""
    name_ok = F.coalesce(text.valid_device_name(c("name")), F.lit(False))
    firsts = first_of_name(registry)
    rows = salted_join(registry.withColumn("_low", F.when(name_ok, F.lower("name"))), firsts, ["_low"], "left")
    known = c("backend").isin(*BACKENDS)
    is_cli = c("backend") == "cli"
    rules = [
        ("name", "invalid device name", ~name_ok),
        ("name", "duplicate device name", c("pos") > c("_first")),
        ("alias", "invalid alias", ~text.valid_device_name(c("alias"))),
        ("address", "invalid host name or address", ~is_address(c("address"))),
        ("config_file", "must be an absolute path", ~F.startswith(c("config_file"), F.lit("/"))),
        ("config_file", "required by the cli backend", is_cli & (c("config_file").isNull() | blank("config_file"))),
        ("backend", "must be one of auto, cli, api", ~known),
        ("device", "address or alias is required", c("address").isNull() & c("alias").isNull()),
        *[(field, "out of range", condition) for field, condition in out.items()],
        ("retry_max_delay", "must be >= initial delay", used("retry_max_delay") < used("retry_initial_delay")),
    ]
    found = F.array(*[
        F.when(bad("_", condition), F.struct(F.lit(field).alias("field"), F.lit(problem).alias("problem")))
        for field, problem, condition in rules
    ])
    return rows.select("pos", "name", F.explode(F.filter(found, lambda v: v.isNotNull())).alias("_v")).select(
        "pos", "name", "_v.field", "_v.problem"
    )


def unknown_limits(limits: DataFrame, registry: DataFrame) -> DataFrame:
    """Per-device retention limits that name no device, case ignored."""
    names = registry.select(F.lower("name").alias("_low")).distinct()
    return limits.withColumn("_low", F.lower("device")).join(names, "_low", "left_anti").drop("_low")


def drop_known(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Found devices that match no existing name, alias or address."""
    low = lambda c: F.lower(F.col(c))
    names = existing.select(F.explode(F.array(low("name"), low("alias"))).alias("_name")).filter("_name is not null").distinct()
    addresses = existing.select(low("address").alias("_address")).filter("_address is not null").distinct()
    rows = found.withColumn("_name", low("name")).withColumn("_address", low("address"))
    unnamed = salted_join(rows, names, ["_name"], "left_anti")
    return salted_join(unnamed, addresses, ["_address"], "left_anti").select(*found.columns)


#: Rows that one task settles in order, and the share of rows that a round has to settle so that rounds go on.
ORDERED, SHARE = 1 << 20, 0.25


def _round(pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names that are sure of their first address, and the rows of the others that still have a chance.

    A name is sure if no smaller name has that address at all. A row has no chance if its address is gone, or the first one of a smaller name:
    whichever of the smaller names gets it, this row never will.
    """
    first = pool.groupBy("_name").agg(F.min_by(F.struct("_address", *pool.columns[2:]), "pos").alias("_r")).select("_name", "_r.*")
    smallest = pool.groupBy("_address").agg(F.min("_name").alias("_holder"))
    claims = first.groupBy("_address").agg(F.min("_name").alias("_claimer"))
    sure = first.join(smallest, "_address").filter(F.col("_holder") == F.col("_name")).select(*pool.columns).checkpoint()
    rest = _without(pool, sure)
    rest = salted_join(rest, claims, ["_address"], "left").filter(F.col("_claimer").isNull() | (F.col("_name") <= F.col("_claimer")))
    return sure, rest.select(*pool.columns).checkpoint()


def _without(pool: DataFrame, taken: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Rows of other names and addresses than those taken."""
    names = (taken if names is None else names).select("_name").distinct()
    others = salted_join(pool, names, ["_name"], "left_anti")
    return salted_join(others, taken.select("_address"), ["_address"], "left_anti").select(*pool.columns)


def _in_order(pool: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The smallest names settled one after the other in one task, and the rows of the others that still have a chance.

    The i-th name needs its first i addresses at most, since only i - 1 names choose before it; so many names are taken that ``most`` rows suffice.
    """
    names = pool.groupBy("_name").agg(F.count("*").alias("_n")).orderBy("_name").limit(most)
    place = F.row_number().over(Window.orderBy("_name"))
    needed = F.sum(F.least("_n", "_place")).over(Window.orderBy("_name").rowsBetween(Window.unboundedPreceding, 0))
    prefix = names.withColumn("_place", place).withColumn("_needed", needed).filter((F.col("_needed") <= most) | (F.col("_place") == 1))
    prefix = prefix.select("_name", "_place").checkpoint()
    choice = F.row_number().over(Window.partitionBy("_name").orderBy("pos"))
    rows = pool.join(prefix, "_name").withColumn("_choice", choice).filter(F.col("_choice") <= F.col("_place"))
    columns = pool.columns

    def settle(frames):
        settled, taken = None, set()
        for pdf in frames:
            won = []
            for row in pdf.itertuples(index=False, name=None):
                if row[0] != settled and row[1] not in taken:
                    settled = row[0]
                    taken.add(row[1])
                    won.append(row)
            yield pd.DataFrame(won, columns=columns)

    sorted_ = rows.select(*columns).coalesce(1).sortWithinPartitions("_name", "pos")
    won = sorted_.mapInPandas(settle, pool.schema).checkpoint()
    return won, _without(pool, won, prefix).checkpoint()


def greedy_targets(found: DataFrame, most: int = ORDERED) -> DataFrame:
    """Accept devices in (lower name, pos) order while neither name nor address is taken.

    Said differently, names choose in order, each its first address that no smaller name has. A round settles all names that are sure of their first
    address, wherever they stand in the order. Where names hang on each other in long chains a round settles few; then the smallest names,
    as many as fit ``most`` rows, are settled in order, and rounds go on with the rest. Rows are reduced to one per (name, address) before anything is
    joined.

    Rows without an address or with a bad name never claim anything, so they leave first.
    """
    ship(found.sparkSession)
    shared_dir(found.sparkSession)
    usable = found.filter(F.coalesce(F.col("address"), F.lit("")) != "").filter(text.valid_device_name(F.col("name")))
    pool = usable.select(
        F.lower("name").alias("_name"), F.lower("address").alias("_address"), "pos", "name", "address"
    ).groupBy("_name", "_address").agg(F.min_by(F.struct("pos", "name", "address"), "pos").alias("_r")).select("_name", "_address", "_r.*").checkpoint()
    accepted, size = [], pool.count()
    while size:
        sure, pool = _round(pool)
        accepted.append(sure)
        before, size = size, pool.count()
        if size > (1 - SHARE) * before:
            won, pool = _in_order(pool, most)
            accepted.append(won)
            size = pool.count()
    out = functools.reduce(DataFrame.unionByName, accepted) if accepted else pool
    return out.select("pos", "name", "address")


def admit(found: DataFrame, existing: DataFrame, **rules) -> DataFrame:
    wanted = found.filter(discovery_match(F.col("name"), **rules))
    return greedy_targets(drop_known(wanted, existing))


def secret_list(secrets: DataFrame) -> DataFrame:
    """Distinct known secrets worth replacing, with the order they are applied in."""
    usable = secrets.filter(F.length("value") >= fixed.MIN_SECRET_LENGTH).select("value").distinct()
    return usable.withColumn("length", F.length("value").cast("long")).orderBy(F.desc("length"), "value")

