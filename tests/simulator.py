"""The shop's rules one event at a time, in plain Python, as the yardstick for the set-based operators.

Ties go to the smallest order, line or id.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal


@dataclass
class Line:
    order_id: int
    part_code: int
    line_no: int
    needed: int
    available: int
    price: int
    requested: object


@dataclass
class Simulator:
    suppliers: dict = field(default_factory=dict)  # part -> supplier of its lowest version
    fits: set = field(default_factory=set)         # (part, model)
    mechanics: list = field(default_factory=list)
    lines: list = field(default_factory=list)
    pending: dict = field(default_factory=dict)    # part -> [quantity, supplier]
    orders: dict = field(default_factory=dict)     # id -> dict
    decisions: dict = field(default_factory=dict)
    vehicles: dict = field(default_factory=dict)   # plate -> model

    def arrive(self, plate, model) -> bool:
        if model not in {m for _, m in self.fits}:
            return False
        self.vehicles[plate] = model
        self.pending = {p: q for p, q in self.pending.items() if q[0] != 0}
        return True

    def choose(self):
        busy = {o["mechanic"] for o in self.orders.values() if o["labor"] == 0}
        free = [] if None in busy else [m for m in sorted(self.mechanics) if m not in busy]
        if free:
            return free[0]
        hours = {}
        for o in self.orders.values():
            hours[o["mechanic"]] = hours.get(o["mechanic"], 0) + o["labor"]
        least = min(hours.values())
        return min(m for m, h in hours.items() if h == least)

    def open(self, plate) -> int:
        number = max(self.orders, default=0) + 1
        self.orders[number] = {"plate": plate, "mechanic": self.choose(), "labor": 0, "quote": 0, "cost": 0,
                               "end": None}
        self.decisions[number] = "Negativo"
        return number

    def reprice(self, order_id, today):
        order = self.orders[order_id]
        if order["labor"] != 0:
            exact = Decimal(order["labor"] * 25) + Decimal(order["quote"]) * Decimal("1.1")
            order["cost"] = int(exact.quantize(Decimal(1), ROUND_HALF_UP))
            order["end"] = today

    def add_line(self, line: Line, today=None) -> bool:
        model = self.vehicles.get(self.orders.get(line.order_id, {}).get("plate"))
        if (line.part_code, model) not in self.fits:
            return False
        self.lines.append(line)
        self.orders[line.order_id]["quote"] += line.price * line.needed
        self.reprice(line.order_id, today)
        return True

    def work(self, order_id, labor, today):
        self.orders[order_id]["labor"] = labor
        self.reprice(order_id, today)

    def decide(self, order_id, outcome):
        if order_id not in self.decisions:
            return
        self.decisions[order_id] = outcome
        if outcome != "Positivo":
            return
        for line in self.lines:
            if line.order_id == order_id and line.part_code in self.suppliers:
                entry = self.pending.setdefault(line.part_code, [0, self.suppliers[line.part_code]])
                entry[0] += line.needed

    def receive(self, part, arrived):
        """One update of the stock on order, with the matching of waiting lines."""
        if part not in self.pending:
            return
        old = self.pending[part][0]
        if arrived is None:
            new = 0
        else:
            rest = old - arrived
            new = old if rest < 0 else max(rest, 0)
        if new < old:
            waiting = sorted((x for x in self.lines if x.part_code == part and x.available == 0),
                             key=lambda x: (x.requested, x.order_id, x.line_no))
            size = sum(1 for x in self.lines if x.part_code == part)
            while size > 0 and waiting and sum(x.needed for x in waiting[:size]) != old - new:
                size -= 1
            if size == 0:
                return
            for line in waiting[:size]:
                line.available = line.needed
        self.pending[part][0] = new

    def recent(self, part, arrived) -> list:
        supplied = sorted((x for x in self.lines if x.part_code == part and x.available != 0),
                          key=lambda x: (x.order_id, x.line_no))
        supplied.sort(key=lambda x: x.requested, reverse=True)
        size = len(supplied)
        while size > 0 and sum(x.available for x in supplied[:size]) != arrived:
            size -= 1
        return supplied[:size]

    def status(self, order_id) -> str:
        own = [x for x in self.lines if x.order_id == order_id]
        if not own:
            return "ACCETTAZIONE"
        if self.decisions.get(order_id) == "Negativo":
            return "PREVENTIVO NON ACCETTATO"
        if sum(x.needed for x in own) != sum(x.available for x in own):
            return "IN ATTESA PEZZI"
        return "IN LAVORAZIONE" if self.orders[order_id]["cost"] == 0 else "CONCLUSO"
