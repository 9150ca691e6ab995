"""Command logs: cleaning, classes, JSON parts, listings, secret references, owners, hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoframe.functions import ids, logs, text
from convoframe.functions.names import free


def clean_errors(log: DataFrame, col: str = "raw", out: str = "message") -> DataFrame:
    """Adds the error lines of a raw log."""
    # Column by column, as each is used more than once and a nested expression would be recomputed.
    lines, errors = free(log, "_lines"), free(log, "_errors")
    found = log.withColumn(lines, logs.log_lines(F.col(col))).withColumn(errors, logs.error_lines(F.col(lines)))
    message = logs.message(F.col(col), F.col(lines), F.col(errors))
    return found.withColumn(out, message).drop(lines, errors)


def classify_errors(log: DataFrame, col: str = "message", out: str = "error_type") -> DataFrame:
    """Adds the class of an error message."""
    return log.withColumn(out, logs.error_type(F.col(col)))


def error_summary(log: DataFrame, col: str = "raw", ts: str = "ts") -> DataFrame:
    """A3: count, share, first and last time per error class."""
    classes = classify_errors(clean_errors(log, col)).groupBy("error_type").agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )
    # The total is a window over the class rows, of which there are five at most.
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return classes.withColumn("share", F.col("n") / total)


def extract_json(log: DataFrame, col: str = "raw", out: str = "json") -> DataFrame:
    """Adds the JSON text within command output, null when there is none. Parse it with
    ``from_json`` and a declared schema."""
    direct = free(log, "_direct")
    marked = log.withColumn(direct, F.coalesce(logs.is_json(F.col(col)), F.lit(False)))
    found = F.when(F.col(direct), F.col(col)).otherwise(logs.scanned_json(F.col(col), F.col(direct)))
    return marked.withColumn(out, found).drop(direct)


def parse_listing(listing: DataFrame, col: str = "raw", out: str = "name") -> DataFrame:
    """One row per name in a CLI table text, with its place in the table from 1."""
    others = [c for c in listing.columns if c != col]
    # Outer, as Spark would otherwise parse every text once more to test for empty listings.
    rows = listing.select(
        *others, F.posexplode_outer(text.listing_names(F.col(col))).alias("_pos", out)
    ).where(F.col("_pos").isNotNull())
    return rows.select(*others, (F.col("_pos") + 1).cast("bigint").alias("place"), out)


def derive_owner(users: DataFrame) -> DataFrame:
    """Owner address, slug, default names and workspace path. All null when a user has neither
    a primary address nor a user name."""
    owner = users.withColumn("email", ids.primary_email(F.col("emails"), F.col("userName")))
    named = owner.withColumn("slug", ids.slug(F.col("email"))).withColumns(
        {
            "scope_name": F.concat("slug", F.lit(ids.SCOPE_SUFFIX)),
            "app_name": F.concat("slug", F.lit(ids.APP_SUFFIX)),
        }
    )
    path = F.concat(F.lit(ids.WORKSPACE_ROOT), "email", F.lit("/"), "app_name")
    return named.withColumn("workspace_path", path).drop("emails", "userName")


def first_valid(
    df: DataFrame,
    profiles: str = "profiles",
    config_host: str = "config_host",
    last_host: str = "last_host",
) -> DataFrame:
    """Adds ``host`` from the first source that has one, its region label and its cloud."""
    sources = [ids.valid_host(F.col(profiles))]
    sources += [ids.not_empty(F.col(c)) for c in (config_host, last_host) if c in df.columns]
    with_host = df.withColumn("host", F.coalesce(*sources))
    kind = with_host.schema[profiles].dataType.elementType
    if "cloud" in kind.fieldNames():
        first = F.get(F.filter(profiles, lambda p: p["valid"]), F.lit(0))
        with_host = with_host.withColumn("cloud", F.upper(first["cloud"]))
    region = F.when(F.col("host").isNotNull(), ids.second_label(F.col("host")))
    return with_host.withColumn("region", region)


def extract_secret_refs(configs: DataFrame, col: str = "raw") -> DataFrame:
    """One row per secret reference in a configuration text. Reads names, never secrets."""
    others = [c for c in configs.columns if c != col]
    refs = (
        configs.where(F.col(col).contains("{{secrets/"))
        .select(*others, F.explode_outer(ids.secret_refs(F.col(col))).alias("_ref"))
        .where(F.col("_ref").isNotNull())
    )
    return refs.select(*others, "_ref.scope", "_ref.name")
