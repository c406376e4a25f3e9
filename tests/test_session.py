"""Settings that every query relies on."""

from razonete.session import JIT_METHOD_BYTES, prepare_session


def test_methods_too_long_to_be_compiled_are_not_fused(spark):
    """HotSpot interprets methods over 8,000 bytes; Spark must not fuse a projection of many rules into one."""
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    prepare_session(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == JIT_METHOD_BYTES == 8000
