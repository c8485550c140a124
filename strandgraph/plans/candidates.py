"""Candidate schemas for the order graph, as literals: one right, the others each with a fault."""

from __future__ import annotations

from ..model import Schema

EVENTS = ("Click", "Error", "Purchase", "Signup", "View")
NODES = {
    "region": (["Region"], ["name"]),
    "nation": (["Nation"], ["name"]),
    "customer": (["Customer"], ["name", "mktsegment", "acctbal?"]),
    "debtor": (["Debtor"], []),
    "supplier": (["Supplier"], ["name", "acctbal"]),
    "part": (["Part"], ["name", "brand", "type", "size", "retailprice"]),
    "order": (["Order"], ["totalprice", "orderdate", "orderstatus", "priority?"]),
    "fulfilled": (["Fulfilled"], []),
    "event": (["Event"], ["ts", "value", "k"]),
    **{e.lower(): ([e], []) for e in EVENTS},
}
EDGES = [
    ("nation_in", "LOCATED_IN", "nation", "region", []),
    ("supplier_in", "LOCATED_IN", "supplier", "nation", []),
    ("lives", "LIVES_IN", "customer", "nation", []),
    ("orders", "HAS_ORDER", "customer", "order", ["orderdate"]),
    ("lines", "HAS_LINE", "order", "part", ["quantity", "extendedprice", "tax", "discount?"]),
    ("supplies", "SUPPLIES", "supplier", "part", []),
    ("emits", "EMITTED", "customer", "event", []),
]
UP = [("debtor_is", "EXTENDS", "debtor", "customer", []), ("fulfilled_is", "EXTENDS", "fulfilled", "order", []), *((f"{e.lower()}_is", "EXTENDS", e.lower(), "event", []) for e in EVENTS)]


def _but(nodes: dict, **changed) -> dict:
    out = {**nodes, **changed}
    return {k: v for k, v in out.items() if v is not None}


PLAIN = {k: v for k, v in NODES.items() if k in ("region", "nation", "customer", "supplier", "part", "order", "event")}
EXTENDING = Schema("extending", NODES, EDGES + UP)
FLAT = Schema("flat", PLAIN, EDGES)
NO_SUPPLIER = Schema("no_supplier", _but(PLAIN, supplier=None), [e for e in EDGES if "supplier" not in e])
NO_NAMES = Schema("no_names", _but(PLAIN, customer=(["Customer"], ["mktsegment"]), part=(["Part"], ["brand"])), EDGES)
TWIN = Schema("twin", _but(PLAIN, nation2=(["Nation"], ["name"])), [*EDGES, ("nation2_in", "LOCATED_IN", "nation2", "region", [])])
EXTRA = Schema("extra_edge", PLAIN, [*EDGES, ("returns", "RETURNS", "customer", "part", []), ("lines2", "HAS_LINE", "order", "part", ["quantity"])])
REVERSED = Schema("reversed", PLAIN, [(i, r, d, s, p) if r == "HAS_ORDER" else (i, r, s, d, p) for i, r, s, d, p in EDGES])
BACKWARD = Schema("backward", NODES, EDGES + [(i, r, d, s, p) if i == "debtor_is" else (i, r, s, d, p) for i, r, s, d, p in UP])
FLAGGED = Schema("flagged", PLAIN, [(*e, True) if e[1] in ("LIVES_IN", "HAS_LINE") else e for e in EDGES])
LOOPED = Schema("looped", NODES, [*EDGES, *UP, ("knows", "KNOWS", "customer", "customer", ["since?"])])
ALL = (EXTENDING, FLAT, NO_SUPPLIER, NO_NAMES, TWIN, EXTRA, REVERSED, BACKWARD, FLAGGED, LOOPED)
