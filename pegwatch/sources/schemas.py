"""Explicit schemas of the input tables."""

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
          "boolean": T.BooleanType()}


def schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


PRICES = schema(symbol="string", hour="bigint", ts="bigint", price="double", confidence="double", source="string",
                unit="string")
RATES = schema(symbol="string", ts="bigint", block="bigint", rate="double", ok="int")
REGISTRY = schema(symbol="string", address="string", category="string", peg="string", in_scope="boolean").add(
    "reference", schema(kind="string", value="double"))
EPISODES = schema(
    symbol="string", category="string", peg="string", t0="bigint", t1="bigint", confirmed_at="bigint",
    hours_below="bigint", min_dev="double", held_min_dev="double", severity="string", ongoing="boolean",
    source="string", suspect="string", terminal="boolean")
LABELS = schema(symbol="string", ts="bigint", dev="double", obs="int", in_episode="int", y24="int", y72="int")
TRANSFERS = schema(block_number="bigint", transaction_index="bigint", ts="bigint", address="string",
                   from_address="string", to_address="string", quantity="string")
MARKET_HISTORY = schema(market_id="string", ts="bigint", field="string", value="double")
