"""The same queries as plain SQL over the raw tables, for checking results with another engine."""

from __future__ import annotations

# Model tables as SQL, by the names the queries below use.
MODEL = {
    "people": "SELECT n_nationkey AS person_id, n_name AS first_name FROM nation",
    "staff": """SELECT s_suppkey AS staff_id, s_nationkey AS person_id,
        CASE WHEN s_suppkey % 5 = 4 THEN 'Segretario' ELSE 'Meccanico' END AS role FROM supplier""",
    "vehicles": """SELECT c_custkey AS plate, 'Brand#' || CAST(c_custkey % 30 + 1 AS VARCHAR) AS brand,
        c_nationkey AS owner_id FROM customer""",
    "jobs": """SELECT o_orderkey AS order_id, o_custkey AS plate, o_custkey % 10 AS mechanic,
        CAST(o_orderdate AS DATE) AS start_date, o_orderstatus,
        CASE WHEN o_orderstatus = 'F' THEN 1 + o_orderkey % 8 ELSE 0 END AS labor FROM orders""",
    "catalog": """SELECT p_partkey AS part_code, p_type AS category,
        p_name || ' ' || p_brand || ' ' || CAST(p_size AS VARCHAR) AS name, p_brand AS brand,
        CAST(p_retailprice AS DECIMAL(18,2)) AS price, p_partkey % 10 AS supplier FROM part""",
    "lines": """SELECT l_orderkey AS order_id, l_partkey AS part_code, l_linenumber AS line_no,
        CAST(l_quantity AS BIGINT) AS needed,
        CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS available,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_shipdate AS DATE) AS requested FROM lineitem""",
    "decisions": """SELECT o_orderkey AS order_id,
        CASE WHEN o_orderstatus = 'P' THEN 'Negativo' ELSE 'Positivo' END AS outcome FROM orders""",
    "waiting": "SELECT * FROM lines WHERE available = 0",
    "pending": """SELECT part_code, CAST(sum(needed) AS BIGINT) AS quantity, part_code % 10 AS supplier
        FROM waiting WHERE order_id IN (SELECT order_id FROM decisions WHERE outcome = 'Positivo')
        GROUP BY part_code""",
    "shelf": "SELECT p_partkey AS part_code, CAST(p_size AS BIGINT) AS quantity, p_partkey % 10 AS supplier FROM part",
    "partly": """SELECT s.part_code, CAST(coalesce(w.q, 0) AS BIGINT) AS quantity, s.supplier
        FROM shelf s LEFT JOIN (SELECT part_code, sum(needed) % 5 AS q FROM lines GROUP BY part_code) w
        ON s.part_code = w.part_code""",
    "on_order": "SELECT * FROM partly WHERE quantity <> 0",
    "used_names": """SELECT DISTINCT CASE WHEN l.part_code % 3 = 0 THEN 'pezzo ' || CAST(l.part_code AS VARCHAR)
        ELSE c.name END AS name FROM lines l JOIN catalog c ON l.part_code = c.part_code""",
    "names": """SELECT name, category FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY part_code) AS nr
        FROM catalog) WHERE nr = 1""",
    "quotes": """SELECT j.order_id, coalesce(sum(l.price * l.needed), 0) AS quote
        FROM jobs j LEFT JOIN lines l ON j.order_id = l.order_id GROUP BY j.order_id""",
    "wanted": """SELECT w.part_code, CAST(sum(w.needed) AS BIGINT) AS quantity, w.part_code % 10 AS supplier
        FROM lines w JOIN decisions d ON w.order_id = d.order_id AND d.outcome = 'Positivo' GROUP BY w.part_code""",
    "prefix": """SELECT *, CAST(sum(needed) OVER (PARTITION BY part_code ORDER BY requested, order_id, line_no
        ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running,
        row_number() OVER (PARTITION BY part_code ORDER BY requested, order_id, line_no) AS nr FROM waiting""",
    "newest": """SELECT *, CAST(sum(available) OVER (PARTITION BY part_code
        ORDER BY requested DESC, order_id, line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running,
        row_number() OVER (PARTITION BY part_code ORDER BY requested DESC, order_id, line_no) AS nr
        FROM lines WHERE available <> 0""",
    "arrivals": """SELECT part_code, CAST(sum(needed) AS BIGINT) + part_code % 2 AS arrived
        FROM prefix WHERE nr <= 1 + part_code % 9 GROUP BY part_code""",
    "recent": """SELECT DISTINCT part_code, unnest([a, b, b + 1]) AS arrived FROM (
        SELECT part_code, CAST(sum(available) FILTER (nr <= 1 + part_code % 7) AS BIGINT) AS a,
            CAST(sum(available) AS BIGINT) AS b FROM newest WHERE nr <= 2 + part_code % 7 GROUP BY part_code)""",
    "sizes": """SELECT r.part_code, r.arrived, coalesce(max(n.nr), 0) AS k FROM recent r
        LEFT JOIN newest n ON n.part_code = r.part_code AND n.running = r.arrived GROUP BY r.part_code, r.arrived""",
    "deliveries": """SELECT part_code, date_diff('day', DATE '1970-01-01', requested) * 1000000000000
        + order_id * 10 + line_no AS seq, available AS arrived FROM lines WHERE available > 0""",
    "purchases": """SELECT user_id AS part_code, event_id AS seq, CAST(ceil(value) AS BIGINT) AS arrived
        FROM events WHERE event_type = 'purchase'""",
}

# A receipt depends on the ones before it, hence the recursion over the number of the receipt.
DECIDED = """
    numbered AS (SELECT *, row_number() OVER (PARTITION BY part_code ORDER BY seq) AS n FROM {receipts}),
    whole AS (SELECT part_code, sum(CASE WHEN available = 0 THEN needed END) AS total FROM lines GROUP BY part_code),
    step AS (
        SELECT r.part_code, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS arrived,
            CAST('' AS VARCHAR) AS outcome, CAST(0 AS BIGINT) AS from_total, CAST(0 AS BIGINT) AS to_total, p.quantity
        FROM (SELECT DISTINCT part_code FROM numbered) r LEFT JOIN pending p ON p.part_code = r.part_code
        UNION ALL
        SELECT part_code, n, seq, arrived, outcome, to_total,
            CASE WHEN outcome = 'applied' THEN to_total + arrived ELSE to_total END,
            CASE WHEN outcome LIKE 'applied%' THEN quantity - arrived ELSE quantity END
        FROM (SELECT s.part_code, r.n, r.seq, r.arrived, s.to_total, s.quantity,
                CASE WHEN s.quantity IS NULL THEN 'refused: part not on order'
                     WHEN s.quantity < r.arrived THEN 'refused: more than on order'
                     WHEN w.part_code IS NULL THEN 'refused: no exact match'
                     WHEN w.total IS NULL OR s.to_total >= w.total THEN 'applied, no line waits'
                     WHEN p.running IS NOT NULL THEN 'applied'
                     ELSE 'refused: no exact match' END AS outcome
            FROM step s JOIN numbered r ON r.part_code = s.part_code AND r.n = s.n + 1
            LEFT JOIN whole w ON w.part_code = s.part_code
            LEFT JOIN prefix p ON p.part_code = s.part_code AND p.running = s.to_total + r.arrived)),
    decided AS (SELECT * FROM step WHERE n > 0)"""

COST = """CAST(round(CAST({labor} * 25 AS DECIMAL(28,3))
    + CAST({quote} AS DECIMAL(28,3)) * CAST(1.1 AS DECIMAL(3,1)), 0) AS BIGINT)"""


def _with(names: str, body: str, extra: str = "", recursive: bool = False) -> str:
    """Put the model tables a query uses in front of it."""
    parts = [f"{name} AS ({MODEL[name]})" for name in names.split()]
    if extra:
        parts.append(extra)
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"


def _decided(receipts: str, body: str) -> str:
    return _with(f"lines decisions waiting pending prefix {receipts}", body, DECIDED.format(receipts=receipts), True)


STOCK = "lines decisions shelf partly on_order wanted"
USAGE = "lines catalog used_names names"

ORACLE: dict[str, str] = {
    "load_tables": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS row_count, "
        f"{' + '.join(f'count({c})' for c in columns.split())} AS value_count FROM {name}" for name, columns in (
            ("region", "r_regionkey r_name"), ("nation", "n_nationkey n_name n_regionkey"),
            ("customer", "c_custkey c_name c_nationkey c_acctbal c_mktsegment"),
            ("supplier", "s_suppkey s_name s_nationkey s_acctbal"),
            ("part", "p_partkey p_name p_brand p_type p_size p_retailprice"),
            ("orders", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority"),
            ("lineitem", "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
                         "l_returnflag l_linestatus l_shipdate"),
            ("events", "event_id ts user_id event_type value props"))),
    "ingest_rows": """SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day,
        CASE WHEN event_type = 'error' THEN NULL
             ELSE CAST(round(CAST(value AS DECIMAL(18,6)), 0) AS BIGINT) END AS amount,
        CASE WHEN event_type = 'error' THEN 'amount not smallint' ELSE '' END AS problem FROM events""",
    "apply_defaults": _with("jobs", "SELECT order_id, labor, 0 AS quote, 0 AS final_cost FROM jobs"),
    "scan_table": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
        strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders""",
    "replace_table": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "stage_temp": _with("lines shelf partly", """
        SELECT 'existing' AS kind, count(*) AS parts, CAST(coalesce(sum(q), 0) AS BIGINT) AS quantity FROM new_parts
        WHERE part_code IN (SELECT part_code FROM partly WHERE quantity <> 0)
        UNION ALL SELECT 'new', count(*), CAST(coalesce(sum(q), 0) AS BIGINT) FROM new_parts
        WHERE part_code NOT IN (SELECT part_code FROM partly WHERE quantity <> 0)""",
        "new_parts AS (SELECT part_code, sum(needed) AS q FROM lines GROUP BY part_code)"),
    "update_by_key": """SELECT o.o_orderkey AS order_id, coalesce(e.last_type, o.o_orderstatus) AS o_orderstatus
        FROM orders o LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS last_type FROM events
            GROUP BY user_id) e ON o.o_orderkey = e.user_id""",
    "update_from_join": _with("lines shelf", """
        SELECT s.part_code, CAST(s.quantity + coalesce(w.q, 0) AS BIGINT) AS quantity, s.supplier FROM shelf s
        LEFT JOIN (SELECT part_code, sum(needed) AS q FROM lines GROUP BY part_code) w
        ON s.part_code = w.part_code"""),
    "upsert_by_key": _with("lines shelf partly on_order", """
        SELECT coalesce(s.part_code, w.part_code) AS part_code,
            CAST(coalesce(s.quantity, 0) + coalesce(w.q, 0) AS BIGINT) AS quantity,
            CASE WHEN s.part_code IS NULL THEN w.part_code % 10 ELSE 99 END AS supplier
        FROM on_order s FULL JOIN
            (SELECT part_code, sum(needed) AS q FROM lines GROUP BY part_code) w ON s.part_code = w.part_code"""),
    "purge_where": _with("lines shelf partly", "SELECT * FROM partly WHERE quantity <> 0"),
    "insert_select": _with("lines shelf partly", """
        SELECT s.part_code, CASE WHEN p.quantity <> 0 THEN p.quantity ELSE s.quantity END AS quantity, s.supplier
        FROM shelf s JOIN partly p ON s.part_code = p.part_code"""),

    "audit_primary_key": """
        SELECT o_orderkey AS order_id, count(*) AS n, 'orders' AS table_name FROM orders GROUP BY o_orderkey
        HAVING count(*) > 1 OR o_orderkey IS NULL
        UNION ALL SELECT l_orderkey, count(*), 'lines' FROM lineitem GROUP BY l_orderkey
        HAVING count(*) > 1 OR l_orderkey IS NULL""",
    "audit_composite_key": """SELECT l_orderkey AS order_id, l_linenumber AS line_no, count(*) AS n FROM lineitem
        GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL""",
    "audit_not_null": _with("jobs", " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, count(*) AS nulls FROM jobs WHERE {test}" for name, test in (
            ("order_id", "order_id IS NULL"), ("plate", "plate IS NULL"), ("mechanic", "mechanic IS NULL"),
            ("start_date", "start_date IS NULL"), ("end_date", "1 = 1"), ("labor", "labor = 0")))),
    "audit_foreign_key": _with("lines jobs", """SELECT order_id, part_code, line_no, needed FROM lines
        WHERE order_id NOT IN (SELECT order_id FROM jobs WHERE labor <> 0)"""),
    "cascade_rename": _with("lines decisions waiting pending catalog", """
        SELECT coalesce(m.new, a.part_code) AS part_code, count(*) AS n, a.table_name FROM (
            SELECT part_code, 'catalog' AS table_name FROM catalog UNION ALL
            SELECT part_code, 'lines' FROM lines UNION ALL SELECT part_code, 'pending' FROM pending) a
        LEFT JOIN (SELECT part_code, part_code + 1000000 AS new FROM catalog
            WHERE brand IN ('Brand#1', 'Brand#2')) m ON a.part_code = m.part_code GROUP BY 1, 3"""),
    "restrict_rename": """SELECT o_orderkey AS old, o_orderkey + 1000000 AS new,
        CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'refused' ELSE 'allowed' END AS verdict
        FROM orders""",
    "audit_enum": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O')",
    "audit_length": """SELECT p_partkey, p_name, p_brand FROM part
        WHERE length(rtrim(p_name)) > 10 OR length(rtrim(p_brand)) > 7""",
    "audit_range": _with("lines", """SELECT order_id, part_code, line_no, CAST(price AS DOUBLE) AS price FROM lines
        WHERE round(price, 0) NOT BETWEEN -32768 AND 32767"""),
    "constraint_report": _with("people staff vehicles jobs lines decisions waiting pending catalog", " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, '{table}' AS table_name, ({query}) AS violations" for rule, table, query in (
            ("key(order_id)", "orders",
             "SELECT count(*) FROM (SELECT 1 FROM jobs GROUP BY order_id HAVING count(*) > 1)"),
            ("key(part_code,version)", "catalog",
             "SELECT count(*) FROM (SELECT 1 FROM catalog GROUP BY part_code HAVING count(*) > 1)"),
            ("key(order_id,part_code)", "lines",
             "SELECT count(*) FROM (SELECT 1 FROM lines GROUP BY order_id, part_code HAVING count(*) > 1)"),
            ("key(part_code)", "pending",
             "SELECT count(*) FROM (SELECT 1 FROM pending GROUP BY part_code HAVING count(*) > 1)"),
            ("not_null(order_id,start_date)", "orders",
             "SELECT count(*) FROM jobs WHERE order_id IS NULL OR start_date IS NULL"),
            ("not_null(requested)", "lines", "SELECT count(*) FROM lines WHERE requested IS NULL"),
            ("foreign_key(order_id)->orders", "lines",
             "SELECT count(*) FROM lines WHERE order_id NOT IN (SELECT order_id FROM jobs)"),
            ("foreign_key(part_code)->pending", "lines",
             "SELECT count(*) FROM lines WHERE part_code NOT IN (SELECT part_code FROM pending)"),
            ("foreign_key(order_id)->lines", "orders",
             "SELECT count(*) FROM jobs WHERE order_id NOT IN (SELECT order_id FROM lines)"),
            ("foreign_key(person_id)->people", "staff",
             "SELECT count(*) FROM staff WHERE person_id NOT IN (SELECT person_id FROM people)"),
            ("enum(role)", "staff", "SELECT count(*) FROM staff WHERE role NOT IN ('Meccanico', 'Segretario')"),
            ("enum(outcome)", "decisions", "SELECT count(*) FROM decisions WHERE outcome <> 'Positivo'"),
            ("length(name)", "catalog", "SELECT count(*) FROM catalog WHERE length(rtrim(name)) > 22"),
            ("length(brand)", "vehicles", "SELECT count(*) FROM vehicles WHERE length(rtrim(brand)) > 15"),
            ("range(price)", "lines", "SELECT count(*) FROM lines WHERE round(price, 0) NOT BETWEEN -32768 AND 32767"),
            ("range(labor)", "orders", "SELECT count(*) FROM jobs WHERE labor NOT BETWEEN -32768 AND 32767")))),

    "vehicle_gate": _with("vehicles catalog", """SELECT plate, brand,
        CASE WHEN brand IN (SELECT brand FROM catalog) THEN '' ELSE 'VEICOLO NON DISPONIBILE' END AS reason
        FROM vehicles"""),
    "part_gate": _with("lines jobs vehicles catalog", """
        SELECT l.order_id, l.part_code, l.line_no,
            CASE WHEN c.part_code IS NULL THEN 'PEZZO INCOMPATIBILE' ELSE '' END AS reason
        FROM lines l LEFT JOIN jobs j ON l.order_id = j.order_id LEFT JOIN vehicles v ON j.plate = v.plate
        LEFT JOIN catalog c ON c.part_code = l.part_code AND c.brand = v.brand"""),
    "order_quote": _with("lines jobs quotes", "SELECT order_id, CAST(quote AS DOUBLE) AS quote FROM quotes"),
    "quote_delta": _with("lines jobs quotes", "SELECT order_id, CAST(quote AS DOUBLE) AS quote FROM quotes"),
    "final_cost": _with("lines jobs quotes", f"""SELECT j.order_id,
        CASE WHEN j.labor <> 0 THEN {COST.format(labor='j.labor', quote='q.quote')} ELSE 0 END AS final_cost,
        CASE WHEN j.labor <> 0 THEN '2024-01-31' END AS end_date
        FROM jobs j JOIN quotes q ON j.order_id = q.order_id"""),
    "default_decision": _with("decisions", "SELECT order_id, outcome FROM decisions"),
    "decide": _with("decisions", """SELECT d.order_id, coalesce(e.outcome, d.outcome) AS outcome FROM decisions d
        LEFT JOIN (SELECT user_id, CASE arg_max(event_type, event_id) WHEN 'signup' THEN 'Positivo'
            ELSE 'Negativo' END AS outcome FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id) e
        ON d.order_id = e.user_id"""),
    "order_status": _with("lines jobs decisions", """
        SELECT j.order_id, CASE WHEN l.n IS NULL THEN 'ACCETTAZIONE'
            WHEN d.outcome = 'Negativo' THEN 'PREVENTIVO NON ACCETTATO'
            WHEN l.needed <> l.available THEN 'IN ATTESA PEZZI'
            WHEN j.labor = 0 THEN 'IN LAVORAZIONE' ELSE 'CONCLUSO' END AS status
        FROM jobs j LEFT JOIN decisions d ON j.order_id = d.order_id
        LEFT JOIN (SELECT order_id, count(*) AS n, sum(needed) AS needed, sum(available) AS available
            FROM lines GROUP BY order_id) l ON j.order_id = l.order_id"""),
    "balance": _with("lines jobs quotes", """
        SELECT CAST(round(sum(CASE WHEN j.labor <> 0 THEN q.quote END) * CAST(0.1 AS DECIMAL(2,1)), 0) AS BIGINT)
            + CAST(sum(j.labor) * 25 AS BIGINT) AS balance FROM jobs j JOIN quotes q ON j.order_id = q.order_id"""),
    "receipt_remaining": _with("lines decisions waiting pending deliveries", """
        SELECT d.part_code, d.seq, d.arrived, CASE WHEN p.quantity - d.arrived < 0 THEN p.quantity
            WHEN p.quantity - d.arrived > 0 THEN p.quantity - d.arrived ELSE 0 END AS remaining
        FROM deliveries d LEFT JOIN pending p ON d.part_code = p.part_code"""),
    "next_ids": """SELECT event_id, row_number() OVER (ORDER BY event_type, ts, event_id)
        + (SELECT max(o_orderkey) FROM orders) AS order_id FROM events""",

    "supplier_of_part": _with("catalog", "SELECT part_code, supplier FROM catalog"),
    "reorder_existing": _with(STOCK, """
        SELECT s.part_code, s.quantity + coalesce(w.quantity, 0) AS quantity, s.supplier
        FROM on_order s LEFT JOIN wanted w ON s.part_code = w.part_code"""),
    "reorder_new": _with(STOCK, """SELECT part_code, quantity, supplier FROM wanted
        WHERE part_code NOT IN (SELECT part_code FROM on_order)"""),
    "pending_stock": _with(STOCK, """
        SELECT part_code, CAST(sum(quantity) AS BIGINT) AS quantity, min(supplier) AS supplier FROM (
            SELECT * FROM on_order UNION ALL SELECT * FROM wanted) GROUP BY part_code"""),
    "allocate_fifo": _with("lines waiting prefix arrivals", """
        SELECT p.order_id, p.part_code, p.line_no, strftime(p.requested, '%Y-%m-%d') AS requested, p.needed,
            CASE WHEN p.nr <= h.last THEN p.needed ELSE 0 END AS available
        FROM prefix p LEFT JOIN (SELECT a.part_code, max(x.nr) AS last FROM arrivals a JOIN prefix x
            ON x.part_code = a.part_code AND x.running = a.arrived GROUP BY a.part_code) h
        ON p.part_code = h.part_code
        UNION ALL SELECT order_id, part_code, line_no, strftime(requested, '%Y-%m-%d'), needed, available
        FROM lines WHERE available <> 0"""),
    "allocate_receipts": _decided("deliveries", """
        SELECT p.order_id, p.part_code, p.line_no, strftime(p.requested, '%Y-%m-%d') AS requested, p.needed,
            CASE WHEN p.running <= d.upto THEN p.needed ELSE 0 END AS available
        FROM prefix p LEFT JOIN (SELECT part_code, max(to_total) AS upto FROM decided GROUP BY part_code) d
        ON p.part_code = d.part_code
        UNION ALL SELECT order_id, part_code, line_no, strftime(requested, '%Y-%m-%d'), needed, available
        FROM lines WHERE available <> 0"""),
    "allocate_receipts_stock": _decided("deliveries", """
        SELECT p.part_code, coalesce(d.quantity, p.quantity) AS quantity, p.supplier FROM pending p
        LEFT JOIN (SELECT part_code, min(quantity) AS quantity FROM decided GROUP BY part_code) d
        ON p.part_code = d.part_code"""),
    "unmatched_receipts": _decided("deliveries", """
        SELECT part_code, seq, arrived, outcome AS reason FROM decided WHERE outcome LIKE 'refused%'"""),
    "recent_prefix_size": _with("lines newest recent sizes", "SELECT part_code, arrived, k FROM sizes"),
    "recent_assignments": _with("lines newest recent sizes", """
        SELECT n.part_code, s.arrived, n.order_id, n.available AS quantity, n.nr AS rank
        FROM newest n JOIN sizes s ON n.part_code = s.part_code AND n.nr <= s.k"""),

    "free_mechanics": _with("staff jobs", """SELECT staff_id, person_id, role FROM staff
        WHERE role = 'Meccanico' AND staff_id NOT IN (SELECT mechanic FROM jobs WHERE labor = 0)"""),
    "least_loaded": _with("jobs", """SELECT mechanic, hours FROM loads
        WHERE hours = (SELECT min(hours) FROM loads)""",
        "loads AS (SELECT mechanic, CAST(sum(labor) AS BIGINT) AS hours FROM jobs GROUP BY mechanic)"),
    "pick_mechanic": _with("staff jobs", """SELECT coalesce(
            (SELECT min(staff_id) FROM staff WHERE role = 'Meccanico'
                AND staff_id NOT IN (SELECT mechanic FROM jobs WHERE labor = 0)),
            (SELECT min(mechanic) FROM loads WHERE hours = (SELECT min(hours) FROM loads))) AS mechanic""",
        "loads AS (SELECT mechanic, sum(labor) AS hours FROM jobs GROUP BY mechanic)"),
    "assign_mechanics": _with("staff jobs vehicles", """
        SELECT q.order_id, q.branch, coalesce(f.staff_id, b.mechanic) AS mechanic FROM queued q
        LEFT JOIN free f ON f.branch = q.branch AND f.nr = q.nr LEFT JOIN best b ON b.branch = q.branch""", """
        placed AS (SELECT j.*, v.owner_id AS branch FROM jobs j JOIN vehicles v ON j.plate = v.plate),
        queued AS (SELECT order_id, branch, row_number() OVER (PARTITION BY branch ORDER BY order_id) AS nr
            FROM placed WHERE o_orderstatus = 'P'),
        free AS (SELECT person_id AS branch, staff_id,
            row_number() OVER (PARTITION BY person_id ORDER BY staff_id) AS nr FROM staff s
            WHERE role = 'Meccanico' AND NOT EXISTS (SELECT 1 FROM placed p WHERE p.o_orderstatus <> 'P'
                AND p.labor = 0 AND p.branch = s.person_id AND p.mechanic = s.staff_id)),
        worked AS (SELECT branch, mechanic, labor FROM placed WHERE o_orderstatus <> 'P' UNION ALL
            SELECT f.branch, f.staff_id, 0 FROM free f JOIN queued q ON q.branch = f.branch AND q.nr = f.nr),
        loads AS (SELECT branch, mechanic, sum(labor) AS hours FROM worked GROUP BY branch, mechanic),
        best AS (SELECT branch, mechanic FROM (SELECT *, row_number() OVER (PARTITION BY branch
            ORDER BY hours, mechanic) AS r FROM loads) WHERE r = 1)"""),

    "mechanic_hours": _with("people staff jobs", """
        SELECT s.staff_id, p.first_name, CAST(sum(j.labor) AS BIGINT) AS hours, count(j.order_id) AS orders
        FROM staff s JOIN jobs j ON s.staff_id = j.mechanic JOIN people p ON p.person_id = s.person_id
        WHERE s.role = 'Meccanico' GROUP BY s.staff_id, p.first_name"""),
    "min_mechanic_hours": _with("people staff jobs", """SELECT min(hours) AS min_hours FROM (
        SELECT CAST(sum(j.labor) AS BIGINT) AS hours FROM staff s JOIN jobs j ON s.staff_id = j.mechanic
        JOIN people p ON p.person_id = s.person_id WHERE s.role = 'Meccanico' GROUP BY s.staff_id)"""),
    "supplier_revenue": _with("lines catalog", """
        SELECT c.supplier, arg_min(c.brand, c.part_code) AS brand, CAST(sum(c.price) AS DOUBLE) AS revenue,
            count(*) AS lines_sold FROM lines l JOIN catalog c ON l.part_code = c.part_code GROUP BY c.supplier"""),
    "parts_one_per_name": _with("catalog", """
        SELECT name, part_code, category, brand, CAST(price AS DOUBLE) AS price, supplier
        FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY part_code) AS nr FROM catalog) WHERE nr = 1"""),
    "unused_parts_by_category": _with(USAGE, """SELECT category, count(*) AS parts FROM names
        WHERE name NOT IN (SELECT name FROM used_names) GROUP BY category"""),
    "unused_all_categories": _with(USAGE, """SELECT c.category, u.parts FROM (SELECT DISTINCT category FROM catalog) c
        LEFT JOIN (SELECT category, count(*) AS parts FROM names WHERE name NOT IN (SELECT name FROM used_names)
            GROUP BY category) u ON c.category = u.category"""),
    "used_all_categories": _with(USAGE, """SELECT c.category, u.parts FROM (SELECT DISTINCT category FROM catalog) c
        LEFT JOIN (SELECT category, count(*) AS parts FROM names WHERE name IN (SELECT name FROM used_names)
            GROUP BY category) u ON c.category = u.category"""),
    "names_by_category": _with("catalog names", "SELECT category, count(*) AS parts FROM names GROUP BY category"),
    "category_usage": _with(USAGE, """SELECT n.category, nullif(count(u.name), 0) AS used,
            nullif(count(*) - count(u.name), 0) AS unused, count(*) AS total
        FROM names n LEFT JOIN used_names u ON n.name = u.name GROUP BY n.category"""),

    "stream_gate": _with("catalog", """
        SELECT e.event_id, e.part_code, e.brand,
            CASE WHEN c.part_code IS NULL THEN 'PEZZO INCOMPATIBILE' ELSE '' END AS reason
        FROM (SELECT event_id, user_id AS part_code,
                'Brand#' || CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 25 + 1 AS VARCHAR) AS brand
            FROM events) e LEFT JOIN catalog c ON c.part_code = e.part_code AND c.brand = e.brand"""),
    "stream_quote": """SELECT user_id AS order_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS quote
        FROM events GROUP BY user_id""",
    "stream_decisions": _with("lines shelf partly on_order", """
        SELECT coalesce(s.part_code, w.part_code) AS part_code,
            CAST(coalesce(s.quantity, 0) + coalesce(w.q, 0) AS BIGINT) AS quantity,
            coalesce(s.part_code, w.part_code) % 10 AS supplier
        FROM on_order s FULL JOIN (
            SELECT w.part_code, sum(w.needed * e.n) AS q FROM lines w JOIN (
                SELECT user_id, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY user_id) e
            ON w.order_id = e.user_id GROUP BY w.part_code) w ON s.part_code = w.part_code"""),
    "stream_receipts": _decided("purchases", """
        SELECT part_code, seq, arrived, outcome, from_total, to_total, quantity FROM decided"""),
    "stream_final_cost": _with("lines jobs quotes", f"""
        SELECT e.event_id AS order_id, e.event_id AS seq, e.labor,
            {COST.format(labor='e.labor', quote='q.quote')} AS final_cost, '2024-01-31' AS end_date
        FROM (SELECT event_id, CAST(floor(value / 10) AS BIGINT) AS labor FROM events WHERE event_type = 'click') e
        JOIN quotes q ON q.order_id = e.event_id WHERE e.labor <> 0"""),
    "stream_default_decision": """SELECT DISTINCT user_id AS order_id, 'Negativo' AS outcome FROM events
        WHERE event_type = 'signup'""",
    "stream_purge": _with("lines shelf partly", "SELECT * FROM partly WHERE quantity <> 0"),
}
# Tables and state of other kinds, the same rows.
ORACLE |= {
    "stream_receipts_in_state": ORACLE["stream_receipts"],
    "stream_decisions_bucketed": ORACLE["stream_decisions"],
    "stream_purge_bucketed": ORACLE["stream_purge"],
    "stream_quote_compacted": ORACLE["stream_quote"],
    "stream_default_decision_bounded": """
        WITH accepted AS (SELECT o_orderkey AS order_id FROM orders WHERE o_orderstatus <> 'P')
        SELECT order_id, 'Positivo' AS outcome FROM accepted UNION ALL
        SELECT DISTINCT user_id * 3, 'Negativo' FROM events
        WHERE event_type = 'signup' AND user_id * 3 NOT IN (SELECT order_id FROM accepted)""",
}
_TARGET = """CASE seq WHEN 1 THEN part_code + 1000000 WHEN 2 THEN part_code + 2000000
            WHEN 3 THEN CASE WHEN part_code % 2 = 0 THEN part_code ELSE part_code + 3000000 END END"""
ORACLE["cascade_rename_in_turn"] = _with("catalog lines decisions waiting pending", f"""
        SELECT part_code, count(*) AS n, table_name FROM (
            SELECT coalesce(name, part_code) AS part_code, table_name FROM (
                SELECT part_code, 'catalog' AS table_name FROM catalog UNION ALL
                SELECT part_code, 'lines' FROM lines UNION ALL SELECT part_code, 'pending' FROM pending)
            LEFT JOIN last ON part_code = first) GROUP BY part_code, table_name""",
    f"""renames AS (
            SELECT 10 * seq + part_code % 7 AS seq, CASE seq WHEN 1 THEN part_code WHEN 2 THEN part_code + 1000000
                ELSE part_code + 2000000 END AS old, {_TARGET} AS new
            FROM catalog, range(1, 4) t(seq) WHERE brand IN ('Brand#1', 'Brand#2')),
        steps AS (
            SELECT old AS first, new AS name, seq FROM renames WHERE seq < 20 UNION ALL
            SELECT s.first, r.new, r.seq FROM steps s JOIN renames r ON r.old = s.name AND r.seq > s.seq),
        last AS (SELECT first, arg_max(name, seq) AS name FROM steps GROUP BY first)""", recursive=True)
# The reports after the changes that the streams bring.
_AFTER = f"""stayed AS (SELECT * FROM lines WHERE available <> 0 OR needed <= 25),
        entries AS (SELECT part_code, category, name, brand, price + CASE WHEN brand = 'Brand#3' THEN 10 ELSE 0 END AS price,
            CASE WHEN brand = 'Brand#3' THEN (supplier + 1) % 10 ELSE supplier END AS supplier
            FROM catalog WHERE brand <> 'Brand#4'),
        used AS ({MODEL["used_names"].replace("FROM lines", "FROM stayed")}),
        first_names AS ({MODEL["names"].replace("FROM catalog", "FROM entries")})"""
ORACLE |= {
    "stream_supplier_revenue": _with("lines catalog", """
        SELECT c.supplier, arg_min(c.brand, c.part_code) AS brand, CAST(sum(c.price) AS DOUBLE) AS revenue,
            count(*) AS lines_sold FROM stayed l JOIN entries c ON l.part_code = c.part_code GROUP BY c.supplier""", _AFTER),
    "stream_category_usage": _with("lines catalog", """
        SELECT n.category, nullif(count(u.name), 0) AS used, nullif(count(*) - count(u.name), 0) AS unused,
            count(*) AS total FROM first_names n LEFT JOIN used u ON n.name = u.name GROUP BY n.category""", _AFTER),
}
_LOADED = """WITH kept AS (SELECT *, CASE WHEN event_type <> 'error' THEN CAST(round(CAST(value AS DECIMAL(18,6)), 0) AS BIGINT) END
        AS amount FROM events WHERE event_id % 5 <> 0)
    SELECT 'rows' AS rule, (SELECT count(*) FROM events) AS violations
    UNION ALL SELECT 'rejected', (SELECT count(*) FROM events WHERE event_id % 5 = 0)
    UNION ALL SELECT 'enum(kind)', (SELECT count(*) FROM kept WHERE event_type NOT IN ('purchase', 'view'))
    UNION ALL SELECT 'length(kind)', (SELECT count(*) FROM kept WHERE length(event_type) > 5)
    UNION ALL SELECT 'not_null(kind,amount)', (SELECT count(*) FROM kept WHERE event_type IS NULL OR amount IS NULL)
    UNION ALL SELECT 'range(event_id)', (SELECT count(*) FROM kept WHERE event_id > 32767)
    UNION ALL SELECT 'stored', (SELECT count(*) FROM kept)
    UNION ALL SELECT 'stored amounts', (SELECT CAST(sum(amount) AS BIGINT) FROM kept)
    UNION ALL SELECT 'stored rejects', (SELECT count(*) FROM events WHERE event_id % 5 = 0)"""
# The routines as SQL functions answer what the operators do.
ORACLE |= {
    "sql_ricevuti": ORACLE["receipt_remaining"],
    "sql_stato_ordine": ORACLE["order_status"],
    "stream_order_status": ORACLE["order_status"],
    "load_audited": _LOADED,
    "stream_audited": _LOADED,
    "sql_limite": ORACLE["recent_prefix_size"],
    "sql_shop": f"""SELECT (SELECT balance FROM ({ORACLE["balance"]})) AS balance,
        (SELECT max(o_orderkey) + 1 FROM orders) AS next_order,
        (SELECT mechanic FROM ({ORACLE["pick_mechanic"]})) AS mechanic""",
    "sql_assegnazioni": ORACLE["recent_assignments"],
}
