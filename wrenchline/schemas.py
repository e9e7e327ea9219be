"""The nine tables: columns, types, declared rules and the fixed values of the model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Roles, decision outcomes, order states and rejection messages.
MECHANIC = "Meccanico"
CLERK = "Segretario"
ACCEPTED = "Positivo"
REFUSED = "Negativo"
STATUS_INTAKE = "ACCETTAZIONE"
STATUS_REFUSED = "PREVENTIVO NON ACCETTATO"
STATUS_WAITING = "IN ATTESA PEZZI"
STATUS_WORKING = "IN LAVORAZIONE"
STATUS_DONE = "CONCLUSO"
VEHICLE_UNKNOWN = "VEICOLO NON DISPONIBILE"
PART_UNSUITABLE = "PEZZO INCOMPATIBILE"
HOURLY_RATE = 25
PARTS_MARKUP = "1.1"
PARTS_SHARE_PERCENT = 10

STR, SMALL, INT, DATE = T.StringType(), T.ShortType(), T.IntegerType(), T.DateType()


def _table(*columns: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in columns])


SCHEMAS: dict[str, T.StructType] = {
    "people": _table(
        ("person_id", STR, False), ("first_name", STR, False), ("last_name", STR, False),
        ("email", STR, True), ("phone", STR, False)),
    "vehicles": _table(
        ("plate", STR, False), ("brand", STR, False), ("model", STR, False), ("trim", STR, False),
        ("owner_id", STR, True)),
    "staff": _table(("staff_id", SMALL, False), ("person_id", STR, True), ("role", STR, False)),
    "orders": _table(
        ("order_id", INT, False), ("plate", STR, True), ("mechanic", SMALL, True), ("start_date", DATE, False),
        ("end_date", DATE, True), ("labor", SMALL, True), ("quote", INT, True), ("final_cost", SMALL, True)),
    "suppliers": _table(("supplier", STR, False), ("contact", STR, False)),
    "catalog": _table(
        ("part_code", STR, False), ("version", SMALL, False), ("category", STR, False), ("name", STR, False),
        ("brand", STR, False), ("model", STR, False), ("trim", STR, False), ("price", INT, False),
        ("supplier", STR, True)),
    "lines": _table(
        ("order_id", INT, False), ("part_code", STR, False), ("name", STR, False), ("needed", SMALL, True),
        ("available", SMALL, True), ("price", INT, True), ("requested", DATE, False)),
    "pending": _table(("part_code", STR, False), ("quantity", SMALL, True), ("supplier", STR, True)),
    "decisions": _table(("order_id", INT, False), ("outcome", STR, False)),
}

# The original table and column names, in declaration order, for data kept under them.
ORIGINAL_NAMES: dict[str, tuple[str, list[str]]] = {
    "people": ("Persone", ["CF", "Nome", "Cognome", "Email", "Cellulare"]),
    "vehicles": ("Veicolo", ["Targa", "Marca", "Modello", "Versione", "Proprietario"]),
    "staff": ("Dipendente", ["Matricola", "CF", "Mansione"]),
    "orders": ("StoricoOrdine", ["NROrdine", "Targa", "Meccanico", "DataInizioLavori", "DataFineLavori",
                                 "Manodopera", "Preventivo", "CostoFinale"]),
    "suppliers": ("Fornitore", ["NomeFornitore", "Contatti"]),
    "catalog": ("Catalogo", ["CodicePezzo", "VersionePezzo", "Categoria", "Pezzo", "Marca", "Modello",
                             "Versione", "Prezzo", "Fornitore"]),
    "lines": ("PezziNecessari", ["NROrdine", "CodicePezzo", "Pezzo", "QuantitaNecessaria",
                                 "QuantitaDisponibile", "Prezzo", "Richiesto"]),
    "pending": ("OrdinePendente", ["CodicePezzo", "Quantita", "Fornitore"]),
    "decisions": ("Decisione", ["NROrdine", "Risultato"]),
}

# Column defaults of the orders table.
DEFAULTS: dict[str, dict[str, int]] = {"orders": {"labor": 0, "quote": 0, "final_cost": 0}}

# Declared text lengths.
LENGTHS: dict[str, dict[str, int]] = {
    "people": {"person_id": 16, "first_name": 10, "last_name": 10, "email": 40, "phone": 15},
    "vehicles": {"plate": 7, "brand": 15, "model": 15, "trim": 100, "owner_id": 16},
    "staff": {"person_id": 16},
    "orders": {"plate": 7},
    "suppliers": {"supplier": 20, "contact": 15},
    "catalog": {"part_code": 4, "category": 50, "name": 70, "brand": 15, "model": 15, "trim": 100,
                "supplier": 20},
    "lines": {"part_code": 4, "name": 70},
    "pending": {"part_code": 4, "supplier": 20},
}


@dataclass(frozen=True)
class Rule:
    """One declared constraint. ``kind`` is key, not_null, foreign_key, enum, length or range."""

    kind: str
    table: str
    columns: tuple[str, ...]
    parent: str | None = None
    parent_columns: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    limit: int | None = None
    type_name: str | None = None
    on_update: str = "no_action"

    @property
    def name(self) -> str:
        text = f"{self.kind}({','.join(self.columns)})"
        return f"{text}->{self.parent}" if self.parent else text


def _fk(table: str, column: str, parent: str, parent_column: str, on_update: str = "cascade") -> Rule:
    return Rule("foreign_key", table, (column,), parent, (parent_column,), on_update=on_update)


KEYS: dict[str, tuple[str, ...]] = {
    "people": ("person_id",), "vehicles": ("plate",), "staff": ("staff_id",), "orders": ("order_id",),
    "suppliers": ("supplier",), "catalog": ("part_code", "version"), "lines": ("order_id", "part_code"),
    "pending": ("part_code",), "decisions": ("order_id",),
}

FOREIGN_KEYS: list[Rule] = [
    _fk("vehicles", "owner_id", "people", "person_id"),
    _fk("staff", "person_id", "people", "person_id"),
    _fk("orders", "plate", "vehicles", "plate", "no_action"),
    _fk("orders", "mechanic", "staff", "staff_id", "no_action"),
    _fk("catalog", "supplier", "suppliers", "supplier"),
    _fk("lines", "part_code", "catalog", "part_code"),
    _fk("lines", "order_id", "orders", "order_id", "no_action"),
    _fk("pending", "part_code", "lines", "part_code"),
    _fk("decisions", "order_id", "orders", "order_id", "no_action"),
]


def declared_rules() -> list[Rule]:
    """Every constraint of the model as audit rules."""
    rules = [Rule("key", table, columns) for table, columns in KEYS.items()]
    for table, schema in SCHEMAS.items():
        required = tuple(f.name for f in schema if not f.nullable)
        rules.append(Rule("not_null", table, required))
    rules += FOREIGN_KEYS
    rules.append(Rule("enum", "staff", ("role",), values=(CLERK, MECHANIC)))
    rules.append(Rule("enum", "decisions", ("outcome",), values=(ACCEPTED, REFUSED)))
    for table, lengths in LENGTHS.items():
        rules += [Rule("length", table, (column,), limit=n) for column, n in lengths.items()]
    for table, schema in SCHEMAS.items():
        rules += [Rule("range", table, (f.name,), type_name=f.dataType.simpleString())
                  for f in schema if isinstance(f.dataType, (T.ShortType, T.IntegerType))]
    return rules
