"""The wire format: 64-bit numbers as text, and checks of requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.functions.ids import id_valid

#: Schema of a pushed operation as JSON text; numbers arrive as strings.
OPERATION = "operationId STRING, documentId STRING, baseVersion STRING, document STRUCT<id: STRING, updatedAt: STRING, deleted: BOOLEAN>, `group` STRING, groupSize INT, _bad STRING"


def int64(text: Column) -> Column:
    """Digits without sign or leading zero, within 64 bits; null where malformed."""
    return F.when(text.rlike("^(0|[1-9][0-9]{0,18})$"), text.try_cast("long"))


def operation(json: Column) -> Column:
    return F.from_json(json, OPERATION, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})


def operation_fault(op: Column, raw: Column) -> Column:
    """Why a pushed operation is malformed, or null; the first fault counts."""
    base = op["baseVersion"]
    # Of the operation itself, whatever members its document has.
    member = F.try_variant_get(F.try_parse_json(raw), "$.baseVersion", "variant")
    kind = F.schema_of_variant(member)
    return (
        F.when(op.isNull() | op["_bad"].isNotNull(), "json")
        .when(member.isNull(), "base-version-absent")
        .when(~kind.isin("STRING", "VOID"), "base-version-number")
        .when(~id_valid(op["operationId"]), "operation-id")
        .when(~id_valid(op["documentId"]), "document-id")
        .when(base.isNotNull() & int64(base).isNull(), "base-version")
        .when(op["document"].isNull() | ~op["document"]["id"].eqNullSafe(op["documentId"]), "document")
        .when(~clock.valid(op["document"]["updatedAt"]), "updated-at")
    )


#: The kinds of outcomes.
OUTCOMES = ("accepted", "conflict", "rejected", "retry-later")


def _member(of: Column, name: str) -> Column:
    return F.try_variant_get(of, f"$.{name}", "variant")


def _is(member: Column, *kinds: str) -> Column:
    """Whether a member is there and of one of these kinds; null counts as VOID."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(member), "^[A-Z]+", 0).isin(*kinds), F.lit(False))


def _text(of: Column, name: str) -> Column:
    return F.try_variant_get(of, f"$.{name}", "string")


def _items(of: Column, name: str) -> Column:
    return F.try_variant_get(of, f"$.{name}", "array<variant>")


def _wrong_number(of: Column, name: str, required: bool = False) -> Column:
    """A 64-bit number is text; it may be absent or null unless it is required."""
    member = _member(of, name)
    sound = F.coalesce(_is(member, "STRING") & int64(_text(of, name)).isNotNull(), F.lit(False))
    return ~sound if required else ~(member.isNull() | _is(member, "VOID") | sound)


def _wrong_texts(of: Column, name: str) -> Column:
    """A list of texts that may be absent or null."""
    member = _member(of, name)
    texts = F.coalesce(F.forall(_items(of, name), lambda x: _is(x, "STRING")), F.lit(False))
    return ~(member.isNull() | _is(member, "VOID") | (_is(member, "ARRAY") & texts))


def _wrong_checkpoint(of: Column) -> Column:
    """A checkpoint must be there; null is the start."""
    return ~_is(_member(of, "checkpoint"), "STRING", "VOID")


def _wrong_document(document: Column) -> Column:
    updated = F.when(_is(_member(document, "updatedAt"), "STRING"), _text(document, "updatedAt"))
    own = F.when(_is(_member(document, "id"), "STRING"), _text(document, "id"))
    return ~(_is(document, "OBJECT") & id_valid(own) & F.coalesce(clock.valid(updated), F.lit(False)) & _is(_member(document, "deleted"), "BOOLEAN"))


def pull_request_fault(raw: Column) -> Column:
    """Why a request for a page is malformed, or null."""
    body = F.try_parse_json(raw)
    limit = _member(body, "limit")
    return (
        F.when(~_is(body, "OBJECT"), "json").when(_wrong_checkpoint(body), "checkpoint").when(~_is(limit, "BIGINT", "INT", "SMALLINT", "TINYINT"), "limit")
        .when(F.try_variant_get(limit, "$", "long") < 1, "limit").when(_wrong_texts(body, "features"), "features")
        .when(~(_member(body, "replica").isNull() | _is(_member(body, "replica"), "STRING", "VOID")), "replica")
    )


def pull_result_fault(raw: Column) -> Column:
    """Why a page of a feed is malformed, or null; members that aren't known are let through."""
    body = F.try_parse_json(raw)
    changes = _items(body, "changes")
    return (
        F.when(~_is(body, "OBJECT"), "json").when(~_is(_member(body, "changes"), "ARRAY"), "changes").when(_wrong_checkpoint(body), "checkpoint").when(~_is(_member(body, "hasMore"), "BOOLEAN"), "has-more")
        .when(F.exists(changes, lambda c: _wrong_number(c, "version", True)), "version").when(F.exists(changes, lambda c: _wrong_document(_member(c, "document"))), "document")
        .when(_wrong_texts(body, "features"), "features").when(_wrong_texts(body, "removals"), "removals")
        .when(_wrong_number(body, "serverTime"), "server-time").when(_wrong_number(body, "retentionHorizon"), "retention-horizon")
    )


def push_result_fault(raw: Column) -> Column:
    """Why the outcomes of a push are malformed, or null."""
    body = F.try_parse_json(raw)
    outcomes = _items(body, "outcomes")
    kind = lambda o: F.when(_is(_member(o, "kind"), "STRING"), _text(o, "kind"))
    own = lambda o: F.when(_is(_member(o, "operationId"), "STRING"), _text(o, "operationId"))
    return (
        F.when(~_is(body, "OBJECT"), "json").when(~_is(_member(body, "outcomes"), "ARRAY"), "outcomes").when(F.exists(outcomes, lambda o: ~id_valid(own(o))), "operation-id")
        .when(F.exists(outcomes, lambda o: ~F.coalesce(kind(o).isin(*OUTCOMES), F.lit(False))), "kind").when(F.exists(outcomes, lambda o: _wrong_number(o, "version")), "version")
    )


def problem(status: Column, code: Column) -> tuple[Column, Column]:
    """(error code, whether trying again can help) of a failed request; a code the server gave wins over its status."""
    own = (
        F.when(status == 401, "unauthorized").when(status == 403, "forbidden").when(status == 413, "payload-too-large").when(status == 429, "rate-limited")
        .when(status >= 500, "unavailable").otherwise("invalid-request")
    )
    found = F.coalesce(code, own)
    return found, found.isin("rate-limited", "unavailable") | (status >= 500)
