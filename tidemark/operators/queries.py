"""The query surface over a collection: filters, declared indexes, keyset pages, counts, key-value ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ids import id_order

MOST_LIMIT = 1000


@dataclass(frozen=True)
class Range:
    """A range over a declared index; null keys come first, below every low bound."""

    key: str
    low: object = None
    high: object = None
    low_inclusive: bool = True
    high_inclusive: bool = True
    descending: bool = False
    only_null: bool = False

    @classmethod
    def equal(cls, key: str, value) -> Range:
        return cls(key, only_null=True) if value is None else cls(key, value, value)

    def condition(self) -> Column:
        key, found = F.col(self.key), F.lit(True)
        if self.only_null:
            return key.isNull()
        if self.low is not None:
            found = found & (key >= F.lit(self.low) if self.low_inclusive else key > F.lit(self.low))
        if self.high is not None:
            upper = key <= F.lit(self.high) if self.high_inclusive else key < F.lit(self.high)
            found = found & (upper if self.low is not None else (upper | key.isNull()))
        return found  # null, which a filter takes for false, so that bounds reach the scan

    def order(self, id_col: str) -> list[Column]:
        key, i = F.col(self.key), id_order(F.col(id_col))
        return [key.desc_nulls_last(), i.desc()] if self.descending else [key.asc_nulls_first(), i.asc()]

    def after(self, key_value, id_value, id_col: str) -> Column:
        """Rows that come after a cursor in this range's order."""
        key, i, at = F.col(self.key), id_order(F.col(id_col)), id_order(F.lit(id_value))
        tie = key.eqNullSafe(F.lit(key_value)) & (i < at if self.descending else i > at)
        if key_value is None:
            beyond = F.lit(False) if self.descending else key.isNotNull()
        elif self.descending:
            beyond = (key < F.lit(key_value)) | key.isNull()
        else:
            beyond = key > F.lit(key_value)
        return beyond | tie


def select(rows: DataFrame, where: Column | None = None, index: Range | None = None, order: list | None = None, skip: int = 0, limit: int = 100, id_col: str = "id", deleted: str = "deleted") -> DataFrame:
    """Live rows that match, by index range or given order or id, without the first `skip`, at most `limit`."""
    if not 1 <= limit <= MOST_LIMIT or skip < 0:
        raise ValueError(f"a limit is 1 to {MOST_LIMIT}, a skip not negative")
    if index is not None and order is not None:
        raise ValueError("an index has its own order")
    found = rows.filter(~F.col(deleted))
    if where is not None:
        found = found.filter(where)
    if index is not None:
        found = found.filter(index.condition())
    by = index.order(id_col) if index is not None else [*order, id_order(F.col(id_col))] if order is not None else [id_order(F.col(id_col))]
    found = found.orderBy(*by)
    return (found.offset(skip) if skip else found).limit(limit)


def page_after(rows: DataFrame, index: Range, key_value, id_value, limit: int, id_col: str = "id") -> DataFrame:
    found = rows.filter(index.condition() & index.after(key_value, id_value, id_col))
    return found.orderBy(*index.order(id_col)).limit(limit)


def count(rows: DataFrame, where: Column | None = None, index: Range | None = None, deleted: str = "deleted") -> DataFrame:
    found = rows.filter(~F.col(deleted))
    for condition in ([where] if where is not None else []) + ([index.condition()] if index is not None else []):
        found = found.filter(condition)
    return found.agg(F.count(F.lit(1)).alias("n"))


#: Fixed values of key tokens: what comes first by kind (null is "0"), the token of NaN, and days and ticks from year 1 to 1970.
TAGS = {"boolean": "1", "integer": "2", "real": "4", "instant": "5", "date": "6", "text": "s"}
NAN_TOKEN = "4ffffffffffffffff~"
DAYS_BEFORE_1970 = 719_162
TICKS_BEFORE_1970 = 621_355_968_000_000_000


def magnitude_bits(value: Column) -> Column:
    """The 63 bits of a double without its sign, as a long. No cast keeps them, so they are made of exponent and fraction.

    Powers of two and quotients by them are exact, so the bits are.
    """
    size = F.abs(value)
    near = F.least(F.greatest(F.floor(F.log2(size)), F.lit(-1022)), F.lit(1023))  # the logarithm may be off by one
    power = F.pow(F.lit(2.0), near.cast("double"))
    low, high = size < power, size >= power * F.lit(2.0)
    exponent = near + F.when(low, -1).when(high, 1).otherwise(0)
    scale = F.when(low, power / F.lit(2.0)).when(high, power * F.lit(2.0)).otherwise(power)
    normal = (exponent + 1023) * F.lit(2**52) + ((size / scale - F.lit(1.0)) * F.lit(2.0**52)).cast("long")
    tiny = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    return F.when(size == F.lit(float("inf")), F.lit(2047 * 2**52)).when(size < F.lit(2.0**-1022), tiny).otherwise(normal)


def key_token(value: Column, kind: str = "integer") -> Column:
    """Text whose order is that of the keys: null first, then the kind's tag, and numbers by digits of fixed width.

    kind: boolean, integer (64 bits), real (floats and decimals, by their double; NaN last, -0 as 0), instant, date or text.
    """
    digits = lambda c, width=16: F.lpad(F.lower(F.hex(c)), width, "0")
    real = value.cast("double")
    body = {
        "boolean": lambda: value.cast("int").cast("string"),
        "integer": lambda: digits(value.cast("long").bitwiseXOR(F.lit(-(2**63)))),
        "real": lambda: digits(magnitude_bits(real).bitwiseXOR(F.when(real < 0, F.lit(2**63 - 1)).otherwise(F.lit(-(2**63))))),
        "instant": lambda: digits(F.unix_micros(value.cast("timestamp")) * 10 + TICKS_BEFORE_1970),
        "date": lambda: digits(F.unix_date(value) + DAYS_BEFORE_1970, 8),
        "text": lambda: value,
    }[kind]()
    found = F.concat(F.lit(TAGS[kind]), body)
    if kind == "real":
        found = F.when(F.isnan(real), NAN_TOKEN).otherwise(found)
    return F.when(value.isNull(), F.lit("0")).otherwise(found)


def index_entries(rows: DataFrame, tokens: dict[str, Column], id_col: str = "id", deleted: str = "deleted") -> DataFrame:
    """(index, key, id) of the live rows, an entry for each index; tokens: key tokens by the index's name."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("index"), token.alias("key")) for name, token in tokens.items())))
    return rows.filter(~F.col(deleted)).select(each.alias("_e"), F.col(id_col).alias("id")).select("_e.index", "_e.key", "id")


def entry_page(entries: DataFrame, index: str, low: str | None = None, high: str | None = None, after: tuple[str, str] | None = None, limit: int = 100) -> DataFrame:
    """A page of an index's entries by (key, id), between two tokens and after a cursor, all in ordinal order. `sources.layouts` stores entries so that bounds prune."""
    found = entries.filter(F.col("index") == index)
    own, at = id_order(F.col("key")), lambda text: id_order(F.lit(text))
    if low is not None:
        found = found.filter(own >= at(low))
    if high is not None:
        found = found.filter(own <= at(high))
    if after is not None:
        key, i = after
        found = found.filter((own > at(key)) | ((own == at(key)) & (id_order(F.col("id")) > at(i))))
    return found.orderBy(id_order(F.col("key")), id_order(F.col("id"))).limit(limit)


def rows_of(page: DataFrame, rows: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows a page of entries stands for, in its order."""
    p = page.select(F.col("key").alias("_key"), F.col("id").alias("_id"))
    return rows.join(p, F.col(id_col) == F.col("_id")).orderBy(id_order(F.col("_key")), id_order(F.col("_id"))).drop("_key", "_id")


def to_rebuild(stored: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """Collections (keys) whose stored signature isn't the one declared now, or that have none: their entries are made anew."""
    s = stored.select(*keys, F.col("signature").alias("_stored"))
    return declared.join(s, keys, "left").filter(~F.col("signature").eqNullSafe(F.col("_stored"))).drop("_stored")


def prefix_page(records: DataFrame, prefix: str, after: str | None, limit: int) -> DataFrame:
    """A page of the keys that start with a prefix, in ordinal order."""
    found = records.filter(F.col("key").startswith(prefix))
    if after is not None:
        found = found.filter(id_order(F.col("key")) > id_order(F.lit(after)))
    return found.orderBy(id_order(F.col("key"))).limit(limit)


def compare_and_set(records: DataFrame, mutations: DataFrame, fence: Column) -> DataFrame:
    """Per batch, whether it applies: the fence holds and every mutation (batch, key, expected) meets the stored revision.

    All or nothing; an expected revision of null means that the key is absent.
    """
    stored = records.select(F.col("key").alias("_k"), "revision")
    met = mutations.join(stored, F.col("key") == F.col("_k"), "left").withColumn("_met", F.col("revision").eqNullSafe(F.col("expected")) & fence)
    return met.groupBy("batch").agg(F.bool_and("_met").alias("applied"), F.count(F.lit(1)).alias("n"))


def write_records(records: DataFrame, mutations: DataFrame, fence: Column) -> DataFrame:
    """The records (key, revision, value) after all batches that apply: each record they write gets the next revision, 1 if it is new.

    mutations: batch, key, expected, value (null deletes). Batches are decided together; of those that write one key only the
    least may apply, as the others would meet a revision that is gone.
    """
    decided = compare_and_set(records, mutations.select("batch", "key", "expected"), fence).filter("applied").select(F.col("batch").alias("_b"))
    met = mutations.join(decided, F.col("batch") == F.col("_b"), "left_semi")
    first = met.groupBy(F.col("key").alias("_f")).agg(F.min("batch").alias("_least"), F.count(F.lit(1)).alias("_n"))
    late = met.join(first.filter("_n > 1"), F.col("key") == F.col("_f")).filter("batch != _least").select(F.col("batch").alias("_l")).distinct()
    done = met.join(late, F.col("batch") == F.col("_l"), "left_anti").select(F.col("key").alias("_k"), F.col("value").alias("_v"))
    both = records.select("key", "revision", "value").join(done, F.col("key") == F.col("_k"), "full_outer").filter(F.col("_k").isNull() | F.col("_v").isNotNull())
    return both.select(F.coalesce("key", "_k").alias("key"), (F.coalesce("revision", F.lit(0)) + F.when(F.col("_k").isNotNull(), 1).otherwise(0)).cast("long").alias("revision"), F.when(F.col("_k").isNotNull(), F.col("_v")).otherwise(F.col("value")).alias("value"))


def index_signature(indexes: DataFrame, keys: list[str]) -> DataFrame:
    """One text per collection of its declared indexes' names and versions; a change of it calls for a rebuild."""
    entry = F.concat_ws("@", "name", F.col("version").cast("string"))
    return indexes.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(entry)), ";").alias("signature"))
