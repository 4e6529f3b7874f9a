"""Support snapshots stored as JSON, read by what each value is.

A snapshot is parsed once, as a VARIANT; each field is taken where it has the type it should have and is
null where it hasn't (a number isn't turned into a string), a list that is something else is empty, and an
entry of a list that isn't an object has null fields. Text that isn't JSON, or names a key twice, is
taken for no snapshot, as is a JSON null; JSON of another kind is a snapshot without content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import rules

# --- fixed values: the present version, statuses and notes ---
VERSION = 1
LEGACY_NOTE = "Snapshot: legacy/unversioned persisted support snapshot interpreted as v1-compatible."
UNSUPPORTED_NOTE = ("Snapshot: persisted support snapshot version ", " is not supported for structured rendering.")
# --- fixed values: fields of the parts; whole numbers, flags, and strings otherwise ---
SCOPE = ("claim_id", "draft_id", "matter_id", "evidence_bundle_id", "scope_kind")
LINK = ("link_id", "claim_id", "segment_id", "source_document_id", "sequence_order", "link_type", "citation_text", "user_confirmed", "anchor", "evidence_role")
EXCLUDED = ("link_id", "claim_id", "segment_id", "code", "message")
ITEM = ("order", "segment_id", "source_document_id", "anchor", "evidence_role", "speaker", "segment_type", "raw_text", "normalized_text")
ASSESSMENT = ("segment_id", "anchor", "role", "contribution")
WHOLE, FLAGS = ("sequence_order", "order"), ("user_confirmed",)


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def string_in(v: Column, path: str = "$") -> Column:
    """The string at a path; null where something else is."""
    return F.when(_kind(_at(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def whole_in(v: Column, path: str) -> Column:
    """The whole number at a path, true and false as 1 and 0; null where something else is, or one beyond a long."""
    return F.when(_kind(_at(v, path)).isin("BIGINT", "BOOLEAN"), F.try_variant_get(v, path, "long"))


def flag_in(v: Column, path: str) -> Column:
    """Whether there is a value that isn't false, zero or empty."""
    x = _at(v, path)
    kind = _kind(x)
    nothing = (kind == "VOID") | (kind == "OBJECT<>") | ((kind == "STRING") & (F.try_variant_get(v, path, "string") == ""))
    number = (kind == "BOOLEAN") | (kind == "BIGINT") | kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
    zero = number & (F.try_variant_get(v, path, "double") == 0)
    none = F.size(F.try_variant_get(v, path, "array<variant>")) == 0
    return x.isNotNull() & ~F.coalesce(nothing, F.lit(False)) & ~F.coalesce(zero, F.lit(False)) & ~F.coalesce(none & kind.startswith("ARRAY"), F.lit(False))


def list_in(v: Column, path: str, of: Callable[[Column], Column]) -> Column:
    """The list at a path, entry by entry; empty where something else is."""
    return F.transform(F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>")), of)


def strings_in(v: Column, path: str) -> Column:
    """The strings of a list that aren't empty."""
    return F.filter(list_in(v, path, lambda x: string_in(x)), lambda x: x != "")


def fields_of(names: tuple[str, ...], otherwise: str | None = None) -> Callable[[Column], Column]:
    """An object's fields by name; strings that are missing, or no strings, are ``otherwise``, but for segment_id."""

    def read(v: Column) -> Column:
        def field(name: str) -> Column:
            path = f"$.{name}"
            value = whole_in(v, path) if name in WHOLE else flag_in(v, path) if name in FLAGS else string_in(v, path)
            return value if otherwise is None or name == "segment_id" else F.coalesce(value, F.lit(otherwise))

        return F.struct(*[field(n).alias(n) for n in names])

    return read


def read(rows: DataFrame, body: str = "support_snapshot", version: str = "support_snapshot_version") -> DataFrame:
    """Rows with status (missing, legacy_unversioned_v1, versioned_v1 or unsupported_version), note and snapshot.

    snapshot is a struct of claim_scope (null where it is no object or has no field), valid_support_links,
    excluded_support_links, support_items, citations and provider_output; its lists are empty and claim_scope is null
    where the status says that nothing is read. Columns named so in ``rows`` are replaced."""
    parsed = rows.withColumn("_v", F.try_parse_json(body))
    parsed = parsed.withColumn("_v", F.when(~F.is_variant_null("_v"), F.col("_v")))
    status = (
        F.when(F.col("_v").isNull(), "missing").when(F.col(version).isNull(), "legacy_unversioned_v1")
        .when(F.col(version) == VERSION, "versioned_v1").otherwise("unsupported_version")
    )
    unsupported = F.concat(F.lit(UNSUPPORTED_NOTE[0]), F.col(version).cast("string"), F.lit(UNSUPPORTED_NOTE[1]))
    note = F.when(F.col("status") == "legacy_unversioned_v1", LEGACY_NOTE).when(F.col("status") == "unsupported_version", unsupported)
    told = parsed.withColumn("status", status).withColumn("note", note)
    told = told.withColumn("_v", F.when(F.col("status").isin("legacy_unversioned_v1", "versioned_v1"), F.col("_v")))
    v = F.col("_v")
    kind = _kind(_at(v, "$.claim_scope"))
    scope = F.struct(*[string_in(v, f"$.claim_scope.{n}").alias(n) for n in SCOPE], strings_in(v, "$.claim_scope.allowed_source_document_ids").alias("allowed_source_document_ids"))
    output = F.struct(
        string_in(v, "$.provider_output.primary_anchor").alias("primary_anchor"),
        list_in(v, "$.provider_output.support_assessments", fields_of(ASSESSMENT, "")).alias("support_assessments"),
    )
    snapshot = F.struct(
        F.when(kind.startswith("OBJECT<") & (kind != "OBJECT<>"), scope).alias("claim_scope"),
        list_in(v, "$.valid_support_links", fields_of(LINK)).alias("valid_support_links"),
        list_in(v, "$.excluded_support_links", fields_of(EXCLUDED)).alias("excluded_support_links"),
        list_in(v, "$.support_items", fields_of(ITEM)).alias("support_items"),
        strings_in(v, "$.citations").alias("citations"), output.alias("provider_output"),
    )
    return told.withColumn("snapshot", snapshot).drop("_v")


def history_fields(snapshots: DataFrame, version: str = "support_snapshot_version") -> DataFrame:
    """Rows of ``read`` with support_snapshot_status, _note, _version and support_snapshot, null without a scope."""
    shown = F.when(F.col("snapshot.claim_scope").isNotNull(), F.col("snapshot"))
    kept = [c for c in snapshots.columns if c not in ("status", "note", "snapshot", "support_snapshot", version)]
    return snapshots.select(
        *kept, F.col("status").alias("support_snapshot_status"), F.col("note").alias("support_snapshot_note"),
        F.col(version).alias("support_snapshot_version"), shown.alias("support_snapshot"),
    )


def audit_view(snapshots: DataFrame, key: str, version: str = "support_snapshot_version") -> DataFrame:
    """What an audit shows of each snapshot that there is; assessments without an anchor, a role or a contribution are left out."""
    s = F.col("snapshot")
    told = F.filter(s["provider_output"]["support_assessments"], lambda a: (a["anchor"] != "") & (a["role"] != "") & (a["contribution"] != ""))
    return snapshots.filter("status != 'missing'").select(
        key, F.col(version).alias("support_snapshot_version"), s["claim_scope"]["scope_kind"].alias("scope_kind"),
        F.coalesce(F.size(s["claim_scope"]["allowed_source_document_ids"]), F.lit(0)).alias("allowed_source_document_count"),
        s["provider_output"]["primary_anchor"].alias("primary_anchor"),
        F.transform(told, lambda a: F.struct(a["anchor"].alias("anchor"), a["role"].alias("role"), a["contribution"].alias("contribution"))).alias("support_assessments"),
        F.transform(s["excluded_support_links"], lambda x: F.struct(x["code"].alias("code"), x["message"].alias("message"))).alias("excluded_support_links"),
        F.col("note").alias("snapshot_note"),
    )


def anchor_and_snippet(snapshots: DataFrame, key: str) -> DataFrame:
    """Key, primary_anchor (the provider's, else the first item's) and snippet: the first assessment, else the first item's text,
    cut to SNIPPET_CHARS; null where there is neither, or the item has no text."""
    output, items = F.col("snapshot.provider_output"), F.col("snapshot.support_items")
    named = F.when(output["primary_anchor"] != "", output["primary_anchor"])
    first, item = F.get(output["support_assessments"], F.lit(0)), F.get(items, F.lit(0))
    raw = F.regexp_replace(item["raw_text"], r"^\s+|\s+$", "")
    short = F.concat(F.regexp_replace(F.substring(raw, 1, rules.SNIPPET_CHARS - 3), r"\s+$", ""), F.lit("..."))
    said = F.when(F.length(raw) > rules.SNIPPET_CHARS, short).otherwise(raw)
    told = F.when(first.isNotNull(), F.concat(first["anchor"], F.lit(": "), first["contribution"])).otherwise(said)
    return snapshots.select(key, F.coalesce(named, item["anchor"]).alias("primary_anchor"), told.alias("snippet"))
