"""The callable routines as Spark SQL functions, under their original names.

They are SQL functions, so Catalyst inlines them: no Python runs per row. Functions over tables read temp views
named after the tables (``orders``, ``lines``, ``decisions``, ``pending``), see ``register``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from wrenchline.operators.orders import balance, order_status
from wrenchline.operators.staff import pick_mechanic
from wrenchline.schemas import ORIGINAL_NAMES, SCHEMAS
from wrenchline.sources.tables import to_original_names


def register_original_views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    """Temp views under the original table and column names, for queries written against those."""
    for name, table in tables.items():
        view, columns = ORIGINAL_NAMES[name]
        known = [c for c in SCHEMAS[name].names if c in table.columns]
        renamed = to_original_names(table.select(*known), name)
        renamed.select(*[c for c in columns if c in renamed.columns]).createOrReplaceTempView(view)


def register(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    """Create the temp views and functions for a set of tables.

    Scalar: ``Ricevuti(arrived, part_code)``, ``Saldo()``, ``prossimo()``, ``Meccanico()``,
    ``StatoOrdine(order_id)``, ``limite(part_code, arrived)``. Table: ``Assegnazioni(arrived, part_code)``, which in
    newest-first order has rank 1, 2, ... ``quantity_left(arrived, on_order)`` is the rule of ``Ricevuti`` for a
    known quantity.
    For whole tables prefer the DataFrame operators, which answer all orders or parts in one pass.
    """
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    order_status(tables["orders"], tables["lines"], tables["decisions"]).createOrReplaceTempView("order_states")
    balance(tables["orders"]).createOrReplaceTempView("shop_balance")
    pick_mechanic(tables["staff"], tables["orders"]).createOrReplaceTempView("next_mechanic")
    part = tables["lines"].schema["part_code"].dataType.simpleString()
    order = tables["lines"].schema["order_id"].dataType.simpleString()
    quantity = tables["lines"].schema["available"].dataType.simpleString()
    tie = ", ".join(c for c in ("order_id", "line_no") if c in tables["lines"].columns)
    newest_first = f"requested DESC, {tie}"

    def create(signature: str, returns: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {returns} RETURN {body}")

    create("quantity_left(arrived BIGINT, on_order BIGINT)", "BIGINT",
           "CASE WHEN on_order - arrived < 0 THEN on_order WHEN on_order - arrived > 0 THEN on_order - arrived "
           "ELSE 0 END")
    create(f"quantity_on_order(wanted {part})", "BIGINT",
           "(SELECT max(quantity) FROM pending WHERE part_code = wanted)")
    create(f"Ricevuti(arrived BIGINT, wanted {part})", "BIGINT", "quantity_left(arrived, quantity_on_order(wanted))")
    create("Saldo()", "BIGINT", "(SELECT max(balance) FROM shop_balance)")
    create("prossimo()", "BIGINT", "(SELECT coalesce(max(order_id), 0) + 1 FROM orders)")
    create("Meccanico()", "BIGINT", "(SELECT max(mechanic) FROM next_mechanic)")
    create(f"StatoOrdine(wanted {order})", "STRING",
           "(SELECT max(status) FROM order_states WHERE order_id = wanted)")
    ranked = (f"SELECT part_code AS code, order_id, available, "
              f"sum(available) OVER (PARTITION BY part_code ORDER BY {newest_first} ROWS UNBOUNDED PRECEDING) AS upto, "
              f"row_number() OVER (PARTITION BY part_code ORDER BY {newest_first}) AS rank "
              f"FROM lines WHERE available <> 0")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW newest_supplied AS {ranked}")
    create(f"limite(wanted {part}, arrived BIGINT)", "BIGINT",
           "(SELECT coalesce(max(rank), 0) FROM newest_supplied WHERE code = wanted AND upto = arrived)")
    create(f"Assegnazioni(arrived BIGINT, wanted {part})",
           f"TABLE (order_id {order}, quantity {quantity}, rank INT)",
           "SELECT s.order_id, s.available, s.rank FROM newest_supplied s JOIN "
           "(SELECT code, max(rank) AS k FROM newest_supplied WHERE upto = arrived GROUP BY code) n "
           "ON s.code = n.code AND s.rank <= n.k WHERE s.code = wanted")
