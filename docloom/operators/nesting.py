"""Which tag stands in which: one forward pass over the tags of a document with a stack of open ones.

Built-in array functions would copy the stack for every tag, so the pass is a small Arrow function. It gets one short
code per markup piece, never the text, and works on a whole document; nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags whose beginning ends others that are still open. The tag, those it ends, those it does not look beyond.
_BLOCKS = (
    "address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "table", "ul",
)
_SCOPES = ("applet", "button", "caption", "html", "marquee", "object", "table", "td", "template", "th")
IMPLIED_ENDS = {
    **{name: (("p",), _SCOPES) for name in _BLOCKS},
    "li": (("li", "p"), ("menu", "ol", "table", "ul")),
    "dt": (("dd", "dt", "p"), ("dl", "table")),
    "dd": (("dd", "dt", "p"), ("dl", "table")),
    "option": (("option",), ("datalist", "optgroup", "select")),
    "optgroup": (("optgroup", "option"), ("select",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tr": (("td", "th", "tr"), ("table", "tbody", "tfoot", "thead")),
    "tbody": (("tbody", "td", "tfoot", "th", "thead", "tr"), ("table",)),
    "thead": (("tbody", "td", "tfoot", "th", "thead", "tr"), ("table",)),
    "tfoot": (("tbody", "td", "tfoot", "th", "thead", "tr"), ("table",)),
}

_FIELDS = "depth: int, parent: int, end: int, own: boolean, around: int"
_TREE_FIELDS = "parent: int, end: int, scope: int, seen: int, inside: int, found: array<int>"


def tag_code(name: Column, closes: Column, opens: Column, alone: Column) -> Column:
    """What :func:`nest` reads of a piece: ``-`` and the name for an end tag, ``+`` for a tag that stays open, ``=`` for one that
    is complete in itself, nothing for other pieces."""
    return F.when(closes, F.concat(F.lit("-"), name)).when(opens & alone, F.concat(F.lit("="), name)).when(opens, F.concat(F.lit("+"), name)).otherwise("")


def nest(codes: Column, implied: bool = False, scope: str | None = None, counted: str | None = None, paths: Sequence[tuple[str, ...]] = ()) -> Column:
    """One struct for each code of a document, all numbers counted from 0 in ``codes``:

    depth, how many tags are open around it; parent, the innermost of them, or -1; end, the piece that ends it (itself, if it
    is complete; the number of pieces, if nothing does); own, whether that is its own end tag; around, the innermost tag
    open after it, or -1.

    An end tag ends the innermost open tag of its name and all that is open in that; without such a tag it is passed over.
    With ``implied``, beginnings of tags end others by ``IMPLIED_ENDS``, as browsers do; without, they end nothing, as
    in plain tag readers.

    For trees, with ``scope``, depth, own and around are left out and these come instead: scope, the innermost open tag of that name, or -1; seen, how many tags named ``counted``
    begin before it, and inside, how many begin in it; found, for each of ``paths`` (names of a child, its child and so
    on) the first tag below it that they lead to, or -1.
    """
    tree = scope is not None
    rules = IMPLIED_ENDS if implied else {}
    routes = [tuple(p) for p in paths]

    @F.arrow_udf(f"array<struct<{_TREE_FIELDS if tree else _FIELDS}>>")
    def walk(codes: pa.Array) -> pa.Array:
        flat, sizes = codes.flatten().to_numpy(zero_copy_only=False).tolist(), [n or 0 for n in codes.value_lengths().to_pylist()]
        total = len(flat)
        depth, parent, end, own, around = [0] * total, [-1] * total, [0] * total, [False] * total, [-1] * total
        scopes, seen, inside, found = [-1] * total, [0] * total, [0] * total, [[-1] * total for _ in routes]
        base = 0
        for size in sizes:
            stack: list[int] = []
            names: list[str] = []
            places: dict[str, list[int]] = {}  # of each name, where in the stack it stands
            n_seen = 0

            def shut(level: int, at: int) -> None:
                while len(stack) > level:
                    p = base + stack.pop()
                    places[names.pop()].pop()
                    end[p], inside[p] = at, n_seen - inside[p]

            for i in range(size):
                at, code = base + i, flat[base + i] or ""
                kind, name = code[:1], code[1:]
                if kind == "-":
                    held = places.get(name)
                    if held:
                        first = stack[held[-1]]
                        shut(held[-1], i)
                        own[base + first] = True
                elif kind and name in rules:
                    ends, stops = rules[name]
                    stop = max((places[x][-1] for x in stops if places.get(x)), default=-1)
                    cuts = [places[x][k] for x in ends if places.get(x) and (k := bisect_right(places[x], stop)) < len(places[x])]
                    if cuts:
                        shut(min(cuts), i)
                depth[at] = len(stack)
                around[at] = parent[at] = stack[-1] if stack else -1
                end[at] = i
                if tree:
                    seen[at] = n_seen
                    scopes[at] = stack[places[scope][-1]] if places.get(scope) else -1
                if kind in ("+", "="):
                    for route, held in zip(routes, found, strict=True):
                        up = len(route)
                        if name == route[-1] and len(stack) >= up and tuple(names[len(names) - up + 1 :]) == route[:-1] and held[base + stack[-up]] < 0:
                            held[base + stack[-up]] = i
                    n_seen += name == counted
                if kind == "+":
                    around[at], end[at], inside[at] = i, size, n_seen
                    places.setdefault(name, []).append(len(stack))
                    stack.append(i)
                    names.append(name)
                elif kind == "=":
                    own[at] = True
            shut(0, size)
            base += size
        numbers = lambda x: pa.array(np.array(x, np.int32))
        if tree:
            starts = np.arange(total + 1, dtype=np.int32) * len(routes)
            columns = [numbers(x) for x in (parent, end, scopes, seen, inside)] + [pa.ListArray.from_arrays(pa.array(starts), numbers(np.array(found, np.int32).reshape(len(routes), total).T.ravel()))]
            labels = ["parent", "end", "scope", "seen", "inside", "found"]
        else:
            columns = [numbers(depth), numbers(parent), numbers(end), pa.array(own, pa.bool_()), numbers(around)]
            labels = ["depth", "parent", "end", "own", "around"]
        offsets = [0]
        for size in sizes:
            offsets.append(offsets[-1] + size)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, names=labels))

    return walk(codes)
