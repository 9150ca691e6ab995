"""Chat ids, owners, hosts and secret references."""

from pyspark.sql import Column
from pyspark.sql import functions as F

CHAT_ID_FORMAT = "yyyyMMdd_HHmmss"

# Default names and folder derived from a user's slug.
SCOPE_SUFFIX = "-chatbot"
APP_SUFFIX = "-ai-chatbot"
WORKSPACE_ROOT = "/Workspace/Users/"

# Fixed value: a secret reference in a configuration text.
SECRET_REF = r"\{\{secrets/([^/]+)/([^}]+)\}\}"


def chat_id_from_ts(ts: Column) -> Column:
    """Wall-clock time as yyyyMMdd_HHmmss.

    Built from the timestamp's own text, so a timestamp without zone never passes through the
    session zone (whose clock changes would move it).
    """
    return F.translate(F.substring(ts.cast("string"), 1, 19), " -:", "_")


def chat_id_to_ts(chat_id: Column) -> Column:
    """The id's wall-clock time as a timestamp without zone; null for ids of another shape."""
    shape = r"^(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})$"
    iso = F.regexp_replace(chat_id, shape, "$1-$2-$3 $4:$5:$6")
    return F.when(chat_id.rlike(shape), iso).try_cast("timestamp_ntz")


def chat_day(chat_id: Column) -> Column:
    """The day part of a timestamp-shaped chat id, the partition key of stored chats."""
    return F.when(chat_id.rlike(r"^\d{8}_"), F.substring(chat_id, 1, 8)).otherwise(F.lit("other"))


def not_empty(text: Column) -> Column:
    return F.when(text != "", text)


def primary_email(emails: Column, user_name: Column) -> Column:
    """The first primary address that has a value, else the user name; null when there is neither."""
    primary = F.filter(emails, lambda e: e["primary"] & e["value"].isNotNull())
    return F.coalesce(not_empty(F.get(primary, F.lit(0))["value"]), not_empty(user_name))


def slug(email: Column) -> Column:
    return F.translate(F.substring_index(email, "@", 1), ".", "-")


def valid_host(profiles: Column) -> Column:
    return not_empty(F.get(F.filter(profiles, lambda p: p["valid"]), F.lit(0))["host"])


def second_label(url: Column) -> Column:
    """The part between the first two dots of a URL, or Unknown."""
    return F.coalesce(F.get(F.split(url, "[.]"), F.lit(1)), F.lit("Unknown"))


def secret_refs(text: Column) -> Column:
    """Every secret reference in a text, as scope/name structs."""
    scopes = F.regexp_extract_all(text, F.lit(SECRET_REF), F.lit(1))
    names = F.regexp_extract_all(text, F.lit(SECRET_REF), F.lit(2))
    return F.arrays_zip(scopes.alias("scope"), names.alias("name"))
