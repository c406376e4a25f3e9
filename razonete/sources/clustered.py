"""The stored order of ledger rows, for data skipping.

Rows of a version are written in the order of a bit-interleaved key of account
and day of the year, behind the year, so a page or row group covers a small
rectangle of both. Parquet's own statistics (row groups and pages) then skip
for a filter on either column, and Bloom filters on N_CONTA and N_CENTRO_CUSTO
skip row groups for values that no order keeps together.

Each half of the key is the value's place among 1,023 quantiles of the rows
written, so crowded accounts or months get as many cells as rare ones. The
quantiles come from one narrow aggregate, and only they reach the driver.

One range exchange over (version, year, key, hash of the other key column) does the dealing. Its borders
come from a sample, so a version of a third of all rows is cut into many tasks
and many small versions share one. A version is written by the tasks whose
ranges it spans: files <= versions + tasks.
The key only arranges rows: any text, null or odd account gives a valid place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_BITS = 10
ACCOUNT_DIGITS = 8  # fixed value: length of an account in the validation rules
BLOOM_COLUMNS = ("N_CONTA", "N_CENTRO_CUSTO")
SALTS = 1 << 16                # pieces that rows of one version, account and day can be cut into
PAGE_ROWS = 4000               # rows of a page, the smallest unit that statistics skip
ROW_GROUP_BYTES = 32 * 1024 * 1024
BLOOM_BYTES = 1024 * 1024      # largest Bloom filter of a column in a row group; smaller ones are chosen by content
_YEAR, _PLACE, _SALT, _ACCOUNT, _DAY = "_ano", "_lugar", "_sal", "_conta", "_dia"


def account_number(col) -> Column:
    """The first eight characters of an account as a number in text order; a text with other characters gets a hashed one."""
    c = F.col(col) if isinstance(col, str) else col
    head = F.rpad(F.substring(c, 1, ACCOUNT_DIGITS), ACCOUNT_DIGITS, "0")
    number = F.when(head.rlike(f"^[0-9]{{{ACCOUNT_DIGITS}}}$"), head.try_cast("long"))
    return F.coalesce(number, F.crc32(F.coalesce(c, F.lit("")).cast("binary")) % F.lit(10 ** ACCOUNT_DIGITS))


def with_codes(rows: DataFrame, columns, bits: int = CODE_BITS) -> DataFrame:
    """Each of the integer ``columns`` replaced by the number of quantiles at or below it, from 0 to 2**bits - 1.

    A binary search in a literal array: one projection for each bit, all inside generated code.
    """
    shares = F.array(*[F.lit(i / 2 ** bits) for i in range(1, 2 ** bits)])
    found = rows.agg(*[F.percentile_approx(c, shares).alias(c) for c in columns]).first()
    cuts = {c: F.split(F.lit(",".join(map(str, found[c]))), ",").cast("array<bigint>") for c in columns if found[c]}
    out = rows.withColumns({f"_i{c}": F.lit(0).cast("int") for c in columns})
    for bit in reversed(range(bits)):
        step = 2 ** bit
        out = out.withColumns({f"_i{c}": F.col(f"_i{c}") + F.when(
            F.col(c) >= F.get(a, F.col(f"_i{c}") + F.lit(step - 1)), F.lit(step)).otherwise(F.lit(0)) for c, a in cuts.items()})
    return out.withColumns({c: F.col(f"_i{c}").cast("long") for c in columns}).drop(*[f"_i{c}" for c in columns])


def _spread(c: Column) -> Column:
    """Bit i of a number of up to 16 bits moves to bit 2i."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return c


def interleave(a: Column, b: Column) -> Column:
    """The bits of two numbers of up to 16 bits in turn, those of ``a`` first."""
    return F.shiftleft(_spread(a), 1).bitwiseOR(_spread(b))


def arrange(rows: DataFrame, part: str) -> DataFrame:
    """``rows`` dealt and sorted by (``part``, year, interleaved account and day); columns unchanged.

    Rows that share all of these (a hot account and day) are told apart by a hash of the cost centre, so the
    range borders can fall between them.
    """
    keyed = rows.withColumns({
        _YEAR: F.coalesce(F.year("DATA"), F.lit(0)),
        _SALT: F.pmod(F.xxhash64("N_CENTRO_CUSTO", "DESCRICAO", "VALOR", "FILIAL"), F.lit(SALTS)).cast("int"),
        _ACCOUNT: account_number("N_CONTA"),
        _DAY: F.coalesce(F.dayofyear("DATA"), F.lit(0)),
    })
    keyed = with_codes(keyed, [_ACCOUNT, _DAY]).withColumn(_PLACE, interleave(F.col(_ACCOUNT), F.col(_DAY)))
    order = [part, _YEAR, _PLACE, _SALT]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop(_ACCOUNT, _DAY, _YEAR, _PLACE, _SALT)


def write_clustered(rows: DataFrame, path: str, part: str, page_rows: int = PAGE_ROWS) -> None:
    """Write ``rows`` arranged, one folder for each value of ``part``, with page limits and Bloom filters."""
    writer = (arrange(rows, part).write.partitionBy(part)
              .option("parquet.block.size", ROW_GROUP_BYTES)
              .option("parquet.page.row.count.limit", page_rows)
              .option("parquet.bloom.filter.max.bytes", BLOOM_BYTES)
              .option("parquet.bloom.filter.adaptive.enabled", "true"))
    for c in BLOOM_COLUMNS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)
