"""Rules, words and cells of whole pages as flat arrays: what tables.py does with the rows of a batch of pages, all pages at once.

Spark deals and groups pages; each step takes and gives a dict of columns, where `page` is the number of the page in its batch and rows ascend by it. Sorts
over all rows and counts along them stand for windows. State: the pages of one Arrow batch, and PAIRS candidates at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Rows = dict[str, np.ndarray]
#: Candidate pairs (of rules that may meet, of a cell and a word) that are looked at together.
PAIRS = 1 << 21


def rows_of(pages: pa.Array) -> Rows:
    """A column of lists of structs as rows. Numbers that are null become NaN; `texts` stay an Arrow array, with `text` as the places in it."""
    flat = pages.flatten()
    counts = pc.fill_null(pc.list_value_length(pages), 0).to_numpy(zero_copy_only=False)
    rows = {"page": np.repeat(np.arange(len(pages)), counts)}
    for field in flat.type:
        column = pc.struct_field(flat, field.name)
        rows[field.name] = np.arange(len(flat)) if field.name == "text" else column.to_numpy(zero_copy_only=False)
    return rows


def pages_of(rows: Rows, n: int, type: pa.DataType, **arrays: pa.Array) -> pa.Array:
    """rows, and further columns that are Arrow arrays, as a column of lists of structs; NaN becomes null again."""
    column = lambda f: pa.array(rows[f.name], f.type, mask=np.isnan(rows[f.name]) if f.type == pa.float64() else None)
    columns = [arrays[f.name] if f.name in arrays else column(f) for f in type.value_type]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(rows["page"], minlength=n)))).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(type.value_type)))


def _take(rows: Rows, at: np.ndarray) -> Rows:
    return {k: v[at] for k, v in rows.items()}


def _order(*keys: np.ndarray) -> np.ndarray:
    return np.lexsort(keys[::-1])


def _opens(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys differ from those of the row before; True in the first row."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _ids(*keys: np.ndarray) -> np.ndarray:
    """A number for each row, from 0, by the order of its keys; equal keys have the same."""
    order = _order(*keys)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(_opens(*(k[order] for k in keys))) - 1
    return out


def _within(group: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Numbers that ascend over all groups, from 0 in each; groups from 0 on without gaps."""
    least = np.full(group.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, number)
    return number - least[group]


def _before(page: np.ndarray, value: np.ndarray, of_page: np.ndarray, of: np.ndarray, equal: bool = False) -> np.ndarray:
    """How many of the rows (page, value) come before each of (of_page, of), equal ones too if asked for."""
    n = len(page)
    asked = np.repeat(np.array([not equal, equal]), (n, len(of)))
    order = _order(np.concatenate((page, of_page)), np.concatenate((value, of)), asked)
    given = order < n
    out = np.empty(len(of), np.int64)
    out[order[~given] - n] = np.cumsum(given)[~given]
    return out


def _pairs(start: np.ndarray, end: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with start[i] <= j < end[i] that keep() leaves."""

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sums = np.concatenate(([0], np.cumsum(np.maximum(end - start, 0))))
        for lo in range(0, int(sums[-1]), PAIRS):
            at = np.arange(lo, min(lo + PAIRS, int(sums[-1])))
            i = np.searchsorted(sums, at, "right") - 1
            j = start[i] + at - sums[i]
            kept = keep(i, j)
            yield i[kept], j[kept]

    found = list(blocks()) or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def rules(edges: Rows, thick: float, shortest: float, snap: float) -> Rows:
    """page, level, at, lo, hi: see tables.rules()."""
    x0, x1, top, bottom = (edges[c] for c in ("x0", "x1", "top", "bottom"))
    clean = ~np.isnan(x0 + x1 + top + bottom) & (x0 <= x1) & (top <= bottom)
    page, x0, x1, top, bottom = (c[clean] for c in (edges["page"], x0, x1, top, bottom))
    across = (bottom - top <= thick) & (x1 - x0 >= bottom - top)
    down = (x1 - x0 <= thick) & ~across
    box = ~across & ~down
    sides = [(across, True, (top + bottom) / 2, x0, x1), (down, False, (x0 + x1) / 2, top, bottom), (box, True, top, x0, x1), (box, True, bottom, x0, x1), (box, False, x0, top, bottom), (box, False, x1, top, bottom)]
    made = [(page[m], np.full(m.sum(), level), at[m], lo[m], hi[m]) for m, level, at, lo, hi in sides]
    page, level, at, lo, hi = (np.concatenate(c) for c in zip(*made, strict=True))
    long = hi - lo >= shortest
    page, level, at, lo, hi = (c[long] for c in (page, level, at, lo, hi))

    order = _order(page, level, at)
    page, level, at, lo, hi = (c[order] for c in (page, level, at, lo, hi))
    apart = _opens(page, level)
    apart[1:] |= at[1:] - at[:-1] > snap
    line = np.cumsum(apart) - 1
    order = _order(line, lo, hi)
    page, level, at, lo, hi, line = (c[order] for c in (page, level, at, lo, hi, line))
    mean = np.bincount(line, at) / np.maximum(np.bincount(line), 1)
    by_end = np.argsort(hi, kind="stable")
    rank = np.empty_like(by_end)
    rank[by_end] = np.arange(len(hi))
    reached = np.maximum.accumulate(line * len(hi) + rank)  # the farthest end so far: lines before this one rank lower
    run = _opens(line)
    if len(hi):
        run[1:] |= lo[1:] > hi[by_end[reached[:-1] % len(hi)]] + snap
    start = np.flatnonzero(run)
    return {"page": page[start], "level": level[start], "at": mean[line[start]], "lo": lo[start], "hi": np.maximum.reduceat(hi, start) if len(start) else hi}


def corners(rules: Rows, reach: float) -> Rows:
    """page, x, y, row, column, left, right, up, down: see tables.corners()."""
    level, upright = _take(rules, np.flatnonzero(rules["level"])), _take(rules, np.flatnonzero(~rules["level"].astype(bool)))
    upright = _take(upright, _order(upright["page"], upright["at"]))
    start = _before(upright["page"], upright["at"], level["page"], level["lo"] - reach)
    end = _before(upright["page"], upright["at"], level["page"], level["hi"] + reach, equal=True)
    meet = lambda i, j: (level["at"][i] >= upright["lo"][j] - reach) & (level["at"][i] <= upright["hi"][j] + reach)
    i, j = _pairs(start, end, meet)
    l, u = _take(level, i), _take(upright, j)  # noqa: E741
    x, y = u["at"], l["at"]
    arms = {"left": l["lo"] < x - reach, "right": l["hi"] > x + reach, "up": u["lo"] < y - reach, "down": u["hi"] > y + reach}
    return {"page": l["page"], "x": x, "y": y, "row": l["lo"], "column": u["lo"], **arms}


def bounded_cells(corners: Rows) -> Rows:
    """page, x0, x1, top, bottom: see tables.bounded_cells()."""
    page, x, y, row, column = (corners[c] for c in ("page", "x", "y", "row", "column"))
    left, right, up, down = (corners[c].astype(bool) for c in ("left", "right", "up", "down"))
    n = len(page)

    def next_along(group: tuple, place: tuple, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A rule's number for each corner, and the next corner on the rule that is marked; -1 for none."""
        order = _order(*group, *place)
        rule = np.cumsum(_opens(*(c[order] for c in group))) - 1
        after = np.minimum.accumulate(np.where(marked[order], np.arange(n), n)[::-1])[::-1]
        after = np.append(after[1:], n) if n else after
        end = np.cumsum(np.bincount(rule))[rule] if n else after
        rules, found = np.empty(n, np.int64), np.empty(n, np.int64)
        rules[order], found[order] = rule, np.where(after < end, order[np.minimum(after, n - 1)], -1)
        return rules, found

    across, to_right = next_along((page, y, row), (x, column), down)
    along, to_low = next_along((page, x, column), (y, row), right)
    opens = np.flatnonzero(right & down & (to_right >= 0) & (to_low >= 0))
    key = lambda a, b: a * (n + 1) + b
    closes = left & up
    opens = opens[np.isin(key(across[to_low[opens]], along[to_right[opens]]), key(across[closes], along[closes]))]
    return {"page": page[opens], "x0": x[opens], "x1": x[to_right[opens]], "top": y[opens], "bottom": y[to_low[opens]]}


def _connected(nodes: np.ndarray) -> np.ndarray:
    """nodes[k, i]: the k-th node of row i. For each row the first row that it is connected with, by rows that share a node."""
    k, n = nodes.shape
    order = np.argsort(nodes.ravel(), kind="stable")
    start = np.flatnonzero(_opens(nodes.ravel()[order]))
    label = np.arange(n)
    while True:
        least = np.minimum.reduceat(label[order % n], start)[nodes].min(axis=0)
        least = least[least]  # labels are rows: one step stands for many along a table
        if np.array_equal(least, label):
            return label
        label = least


def placed_cells(cells: Rows, least: int) -> Rows:
    """cells with table_index, row_index, column_index, rowspan, colspan: see tables.placed_cells()."""
    cells = _take(cells, _order(*(cells[c] for c in ("page", "top", "x0", "bottom", "x1"))))
    page, n = cells["page"], len(cells["page"])
    if n:
        corner = [np.concatenate([cells[c] for c in sides]) for sides in (("x0", "x1", "x0", "x1"), ("top", "top", "bottom", "bottom"))]
        label = _connected(_ids(np.tile(page, 4), *corner).reshape(4, n))
        kept = np.bincount(label, minlength=n)[label] >= least
        cells, label = _take(cells, kept), label[kept]
        page = cells["page"]
    else:
        label = page
    table = _ids(label)
    place = {"table_index": _within(page, table) + 1 if len(page) else table}

    def span(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of a side among its table's distinct ones, and how many of these come before the other side."""
        number = _ids(table, lo)
        sides = np.zeros(number.max(initial=-1) + 1), np.zeros(number.max(initial=-1) + 1, np.int64)
        sides[0][number], sides[1][number] = lo, table
        return (_within(table, number), _before(sides[1], sides[0], table, hi) - number) if len(table) else (number, number)

    place["row_index"], place["rowspan"] = span(cells["top"], cells["bottom"])
    place["column_index"], place["colspan"] = span(cells["x0"], cells["x1"])
    return cells | place


def lines(words: Rows, gap: float) -> Rows:
    """words that have a height, with the number of their line on the page: see grids.lines_of_words()."""
    words = _take(words, ~np.isnan(words["top"]))
    words = _take(words, _order(words["page"], words["top"]))
    new = np.flatnonzero(_opens(words["page"], words["top"]))
    line, out, page, head = -1, [], -1, 0.0
    for p, top in zip(words["page"][new].tolist(), words["top"][new].tolist(), strict=True):
        if p != page:
            page, line, head = p, 0, top
        elif top - head > gap:
            line, head = line + 1, top
        out.append(line)
    return words | {"line": np.repeat(np.array(out, np.int64), np.diff(np.append(new, len(words["page"]))))}


def _joined(group: np.ndarray, n: int, texts: pa.Array, by: str) -> pa.Array:
    """Texts in n groups, which ascend, joined; nulls are left out, and a group without any is empty."""
    there = texts.is_valid().to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(np.bincount(group[there], minlength=n)))).astype("int32")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), texts.drop_null()), by)


def _reading_order(texts: pa.Array, *keys: np.ndarray) -> np.ndarray:
    """Order by the keys; where all are equal, by text."""
    order = _order(*keys)
    if _opens(*(k[order] for k in keys)).all():
        return order
    return _order(*keys, pc.rank(texts, null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64))


def texts_of(cells: Rows, words: Rows, texts: pa.Array) -> pa.Array:
    """The text of each cell: words whose middle it holds, lines from top to bottom, words from left to right."""
    middle = {"x": (words["x0"] + words["x1"]) / 2, "y": (words["top"] + words["bottom"]) / 2}
    words = words | middle
    words = _take(words, ~np.isnan(words["x"]) & ~np.isnan(words["y"]))
    words = _take(words, _order(words["page"], words["y"]))
    start, end = (_before(words["page"], words["y"], cells["page"], cells[c]) for c in ("top", "bottom"))
    cell, word = _pairs(start, end, lambda i, j: (words["x"][j] >= cells["x0"][i]) & (words["x"][j] < cells["x1"][i]))
    own = texts.take(pa.array(words["text"][word]))
    order = _reading_order(own, cell, words["line"][word], words["x0"][word])
    cell, line = cell[order], words["line"][word][order]
    new = _opens(cell, line)
    return _joined(cell[new], len(cells["page"]), _joined(np.cumsum(new) - 1, int(new.sum()), own.take(pa.array(order)), " "), "\n")


def _placed(values: np.ndarray) -> np.ndarray:
    """What words without a place count as: left of all others."""
    return np.where(np.isnan(values), -np.inf, values)


def blocks(words: Rows, gap: float, least: int) -> Rows:
    """words of lines in columns with table_index and row_index: see tables.blocks()."""
    words = _take(words, _order(words["page"], words["line"], _placed(words["x0"]), _placed(words["x1"])))
    opens = _opens(words["page"], words["line"])
    line = np.cumsum(opens) - 1
    wide = np.zeros(len(line), bool)
    wide[1:] = ~opens[1:] & (words["x0"][1:] - words["x1"][:-1] > gap)
    kept = np.bincount(line[wide], minlength=line.max(initial=-1) + 1)[line] > 0
    words = _take(words, kept)
    page, number = words["page"], words["line"]
    opens = _opens(page, number)
    apart = _opens(page)
    apart[1:] |= number[1:] - number[:-1] > 1
    block = np.cumsum(apart) - 1
    row = _within(block, np.cumsum(opens) - 1)
    tall = np.zeros(block.max(initial=-1) + 1, np.int64)
    np.maximum.at(tall, block, row)
    kept = tall[block] >= least - 1
    words, block, row = _take(words, kept), block[kept], row[kept]
    pages = _ids(words["page"])
    return words | {"table_index": _within(pages, _ids(block)) + 1 if len(block) else block, "row_index": row}


def rivers(words: Rows, least: float, share: float) -> Rows:
    """page, table_index, x, lo, hi: see tables.rivers()."""
    table = _ids(words["page"], words["table_index"])
    tables = table.max(initial=-1) + 1
    page, index, lines = (np.zeros(tables, np.int64) for _ in range(3))
    page[table], index[table] = words["page"], words["table_index"]
    np.maximum.at(lines, table, words["row_index"].astype(np.int64) + 1)
    x, n = _placed(np.concatenate((words["x0"], words["x1"]))), np.repeat((1, -1), len(table))
    table = np.tile(table, 2)
    order = _order(table, x)
    table, x, n = table[order], x[order], n[order]
    start = np.flatnonzero(_opens(table, x))
    # What is open after all sides of a place; it is 0 at the end of each table.
    table, x, open_ = table[start], x[start], np.cumsum(n)[np.append(start[1:], len(n)) - 1] if len(n) else n
    last = np.append(_opens(table)[1:], True) if len(table) else np.zeros(0, bool)
    low = (open_ <= lines[table] * share) & ~last
    begins, ends = low.copy(), low.copy()
    begins[1:] &= ~(low[:-1] & (table[1:] == table[:-1]))
    ends[:-1] &= ~(low[1:] & (table[1:] == table[:-1]))
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    first += np.isneginf(x[first])  # a river has no side where words have none
    first, last = first[first <= last], last[first <= last]
    lo, hi, table = x[first], x[last + 1], table[first]
    kept = hi - lo >= least
    lo, hi, table = lo[kept], hi[kept], table[kept]
    return {"page": page[table], "table_index": index[table], "x": (lo + hi) / 2, "lo": lo, "hi": hi}


def spaced_cells(words: Rows, rivers: Rows, texts: pa.Array) -> tuple[Rows, pa.Array]:
    """The cells of blocks that rivers part: page, table_index, row_index, column_index, x0, x1, top, bottom; and their texts."""
    table = _ids(np.concatenate((words["page"], rivers["page"])), np.concatenate((words["table_index"], rivers["table_index"])))
    own, of_rivers = table[: len(words["page"])], np.sort(table[len(words["page"]) :])
    order = _order(table[len(words["page"]) :], rivers["x"])
    passed = _before(of_rivers, rivers["x"][order], own, _placed((words["x0"] + words["x1"]) / 2))
    column = passed - np.searchsorted(of_rivers, own)
    order = _reading_order(texts.take(pa.array(words["text"])), own, words["row_index"], column, _placed(words["x0"]))
    words, own, column = _take(words, order), own[order], column[order]
    new = _opens(own, words["row_index"], column)
    start = np.flatnonzero(new)
    least = lambda c, f: f.reduceat(words[c], start) if len(start) else words[c]
    cells = _take({k: words[k] for k in ("page", "table_index", "row_index")} | {"column_index": column}, start)
    cells |= {"x0": least("x0", np.fmin), "x1": least("x1", np.fmax), "top": least("top", np.fmin), "bottom": least("bottom", np.fmax)}
    cells |= {"rowspan": np.ones(len(start), np.int64), "colspan": np.ones(len(start), np.int64)}
    return cells, _joined(np.cumsum(new) - 1, len(start), texts.take(pa.array(words["text"])), " ")


def counts(source: pa.Array, found: pa.Array) -> pa.Array:
    """Two columns of lists of texts: see tables._counts()."""
    n = len(source)
    lists = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) for c in (source, found)]
    page = np.concatenate([np.repeat(np.arange(n), of) for of in lists])
    there = np.repeat((True, False), [int(of.sum()) for of in lists])
    texts = pa.concat_arrays([source.flatten(), found.flatten()]).dictionary_encode()
    rank = pc.rank(texts.dictionary, tiebreaker="dense").to_numpy().astype(np.int64)
    token = texts.indices.to_numpy(zero_copy_only=False)
    order = _order(page, rank[token])
    page, there, token = page[order], there[order], token[order]
    new = _opens(page, token)
    group, start = np.cumsum(new) - 1, np.flatnonzero(new)
    expected, actual = (np.bincount(group[m], minlength=len(start)) for m in (there, ~there))
    page, token = page[start], token[start]
    sums = lambda of: pa.array(np.bincount(page, of, minlength=n).astype(np.int64))
    gap = pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())]))

    def gaps(more: np.ndarray) -> pa.Array:
        kept = more > 0
        return pages_of({"page": page[kept], "n": more[kept]}, n, gap, token=texts.dictionary.take(pa.array(token[kept])))

    columns = [sums(expected), sums(np.minimum(expected, actual)), gaps(expected - actual), gaps(actual - expected)]
    return pa.StructArray.from_arrays(columns, names=["reference_tokens", "matched_tokens", "missing_tokens", "extra_tokens"])
