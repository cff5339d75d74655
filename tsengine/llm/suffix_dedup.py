"""Removal of byte strings that occur earlier, on suffixes sorted by deep-shallow sorting.

Every byte covered by a string of `LENGTH` bytes that also starts earlier in the corpus is to go. Sorting all suffixes
of a corpus would move a hundred bytes for each byte of text, so suffixes are taken at content-defined anchors
(`anchors.py`): equal strings of LENGTH bytes have the same anchor, so only contexts of equal anchors are compared.

1. One pass over the texts emits, for each anchor, its gram's hash, a hash of its whole context, and its place.
   Contexts repeated within a task are settled there: all but the earliest occurrence are spans to remove.
2. By gram: contexts of a gram equal in their hashes (64 bits of the gram, 64 of the whole context) are settled alike. A gram with one context is done. Where contexts
   differ (at the edges of repeats, and by chance), the earliest of each context is requested as text.
3. Requested contexts are cut from the texts and sent to their gram. There the suffixes from the anchors on, and the
   reversed prefixes before them, are sorted (multikey quicksort, then blind tries); common prefixes of neighbours give
   how far each pair of contexts agrees to both sides, and so the exact span each shares with an earlier one.
4. Spans are merged per document and cut out.

Hot anchors: a gram with more than `FEW` distinct contexts in a task sends them by their own hashes, with a note to the
gram; a gram with more than `MANY` contexts has its contexts sent as single windows, each as two hashes of its bytes.
So neither a common passage nor a common phrase gathers in one task: any key has a few rows at most from each task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .anchors import LENGTH, anchors, window_hashes
from .staging import arrow_map, stage
from .suffix_sort import deep_shallow

U = np.uint64
FEW, MANY = 32, 256
#: Anchors, and bytes of contexts, that a task holds at a time.
HELD, HELD_BYTES = 1 << 20, 8 << 20
ANCHOR, HOT, NOTE, SPAN, ASK, ASK_WINDOWS = range(6)
PLACES = "key long, kind byte, c long, doc long, m long, lo short, n short"
ORDERS = "doc long, kind byte, key long, a long, b long, lo short"
TEXTS = "key long, c long, kind byte, doc long, a long, b long, lo short, context binary"


def merge(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of the spans [a, b) of each row, touching ones joined, by row and place."""
    if not len(row):
        return row, a, b
    order = np.lexsort((b, a, row))
    row, a, b = row[order], a[order], b[order]
    rank = np.cumsum(np.append(0, row[1:] != row[:-1]))
    shift = int(b.max()) + 2
    reach = np.maximum.accumulate(b + rank * shift)
    new = np.append(True, (a[1:] + rank[1:] * shift > reach[:-1]))
    at = np.flatnonzero(new)
    return row[at], a[at], np.append(reach[at[1:] - 1], reach[-1]) - rank[at] * shift


def _runs(*keys: np.ndarray) -> np.ndarray:
    """True where any of the keys differs from the element before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def settle(h: np.ndarray, c: np.ndarray, doc: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by (h, c, doc, m); whether each element in it is its context's earliest; the context's run number."""
    order = np.lexsort((m, doc, c, h))
    new = _runs(h[order], c[order])
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)[run]
    return order, (doc[order] == doc[order][first]) & (m[order] == m[order][first]), run


def _batch(schema: list[tuple[str, pa.DataType]], columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    made = [pa.array(np.asarray(columns[k]).astype(t.to_pandas_dtype())) if k in columns and t != pa.binary() else pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in schema]
    return pa.RecordBatch.from_arrays(made, [k for k, _ in schema])


_L, _S, _B = pa.int64(), pa.int16(), pa.int8()
PLACE_TYPES = [("key", _L), ("kind", _B), ("c", _L), ("doc", _L), ("m", _L), ("lo", _S), ("n", _S)]
ORDER_TYPES = [("doc", _L), ("kind", _B), ("key", _L), ("a", _L), ("b", _L), ("lo", _S)]
TEXT_TYPES = [("key", _L), ("c", _L), ("kind", _B), ("doc", _L), ("a", _L), ("b", _L), ("lo", _S), ("context", pa.binary())]


def _doc_key(doc: np.ndarray) -> np.ndarray:
    return tx.mix(doc.astype(np.int64).view(U) + U(77)).view(np.int64)


def _places(batches):
    held: list[tuple] = []

    def flush():
        doc, m, lo, n, h, c = (np.concatenate(x) for x in zip(*held, strict=True))
        order, earliest, _ = settle(h, c, doc, m)
        gone = order[~earliest]
        d, a, b = merge(doc[gone], m[gone] - lo[gone], m[gone] - lo[gone] + n[gone] - 1 + LENGTH)
        yield _batch(PLACE_TYPES, {"key": _doc_key(d), "kind": np.full(len(d), SPAN), "c": b, "doc": d, "m": a, "lo": np.zeros(len(d)), "n": np.zeros(len(d))})
        keep = order[earliest]
        keep = keep[_runs(h[keep], c[keep], doc[keep], m[keep])]
        new = _runs(h[keep])
        gram = np.cumsum(new) - 1
        hot = np.bincount(gram, _runs(h[keep], c[keep]))[gram] > FEW if len(keep) else new
        key = np.where(hot, tx.mix(h[keep] ^ c[keep]), h[keep]).view(np.int64)
        yield _batch(PLACE_TYPES, {"key": key, "kind": np.where(hot, HOT, ANCHOR), "c": c[keep].view(np.int64), "doc": doc[keep], "m": m[keep], "lo": lo[keep], "n": n[keep]})
        note = np.unique(h[keep][hot]).view(np.int64)
        if len(note):
            zero = np.zeros(len(note))
            yield _batch(PLACE_TYPES, {"key": note, "kind": np.full(len(note), NOTE), "c": zero, "doc": zero, "m": zero, "lo": zero, "n": zero})

    count = 0
    for batch in batches:
        for piece in tx.slices(batch, "text"):
            data, offsets = tx.flat(piece.column("text"))
            row, at, first, last, h = anchors(data, offsets)
            c = tx.span_hashes(data, first, last + LENGTH) ^ tx.mix((at - first).astype(U))
            doc = piece.column("doc").to_numpy()[row]
            held.append((doc, at - offsets[row], at - first, last - first + 1, h, c))
            count += len(h)
            if count >= HELD:
                yield from flush()
                held, count = [], 0
    if count:
        yield from flush()


def _by_key(batches, rows: int, size=None):
    """Tables that hold whole keys, of about rows rows or size bytes; keys must follow each other."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows if size is None else batch.nbytes
        if n >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column("key").to_numpy()
            cut = int(np.flatnonzero(_runs(key))[-1])
            if cut:
                yield t.slice(0, cut)
                held = t.slice(cut).to_batches()
                n = len(t) - cut if size is None else t.slice(cut).nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _orders(batches):
    for t in _by_key(batches, HELD):
        key, kind, c, doc, m, lo, n = (t.column(k).to_numpy() for k, _ in PLACE_TYPES)
        lo, n = lo.astype(np.int64), n.astype(np.int64)
        s = kind == SPAN
        if s.any():
            yield _batch(ORDER_TYPES, {"doc": doc[s], "kind": kind[s], "key": key[s] * 0, "a": m[s], "b": c[s], "lo": lo[s]})
        noted = np.unique(key[kind == NOTE])
        s = (kind == ANCHOR) | (kind == HOT)
        key, kind, c, doc, m, lo, n = (x[s] for x in (key, kind, c, doc, m, lo, n))
        order, earliest, _ = settle(key, c, doc, m)
        gone, keep = order[~earliest], order[earliest]
        d, a, b = merge(doc[gone], m[gone] - lo[gone], m[gone] - lo[gone] + n[gone] - 1 + LENGTH)
        yield _batch(ORDER_TYPES, {"doc": d, "kind": np.full(len(d), SPAN), "key": d * 0, "a": a, "b": b, "lo": d * 0})
        if not len(keep):
            continue
        group = np.cumsum(_runs(key[keep])) - 1
        contexts = np.bincount(group, _runs(key[keep], c[keep]))[group]
        windows = (kind[keep] == HOT) | (contexts > MANY) | np.isin(key[keep], noted)
        ask = windows | (contexts > 1)
        keep, windows = keep[ask], windows[ask]
        start = m[keep] - lo[keep]
        yield _batch(ORDER_TYPES, {"doc": doc[keep], "kind": np.where(windows, ASK_WINDOWS, ASK), "key": key[keep], "a": start, "b": start + n[keep] - 1 + LENGTH, "lo": lo[keep]})


def _contexts(batches):
    """Texts with their requests in; contexts out, and the spans of windows repeated within the task."""
    held: list[tuple] = []

    def flush():
        h, c, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order, earliest, _ = settle(h, c, doc, at)
        gone, keep = order[~earliest], order[earliest]
        keep = keep[_runs(h[keep], c[keep], doc[keep], at[keep])]
        d, a, b = merge(doc[gone], at[gone], at[gone] + LENGTH)
        yield _batch(TEXT_TYPES, {"key": _doc_key(d), "c": d * 0, "kind": np.full(len(d), SPAN), "doc": d, "a": a, "b": b, "lo": d * 0})
        yield _batch(TEXT_TYPES, {"key": h[keep].view(np.int64), "c": c[keep].view(np.int64), "kind": np.full(len(keep), ASK_WINDOWS), "doc": doc[keep], "a": at[keep], "b": at[keep] + LENGTH, "lo": keep * 0})

    count = 0
    for batch in batches:
        for piece in tx.slices(batch, "text"):
            data, offsets = tx.flat(piece.column("text"))
            asked = piece.column("asked")
            row = np.repeat(np.arange(piece.num_rows), _list_sizes(asked))
            kind, key, a, b, lo = (x.to_numpy() for x in asked.flatten().flatten())
            doc = piece.column("doc").to_numpy()[row]
            base = offsets[row]
            s = np.flatnonzero(kind == ASK)
            if len(s):
                raw = data.tobytes()
                cut = [raw[x:y] for x, y in zip((base[s] + a[s]).tolist(), (base[s] + b[s]).tolist(), strict=True)]
                yield _batch(TEXT_TYPES, {"key": key[s], "c": s * 0, "kind": kind[s], "doc": doc[s], "a": a[s], "b": b[s], "lo": lo[s], "context": cut})
            s = np.flatnonzero(kind == ASK_WINDOWS)
            if len(s):
                n = b[s] - a[s] - LENGTH + 1
                own = np.repeat(s, n)
                at = a[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                begin = base[own] + at
                held.append((tx.span_hashes(data, begin, begin + LENGTH), window_hashes(data, begin), doc[own], at))
                count += len(own)
                if count >= HELD:
                    yield from flush()
                    held, count = [], 0
    if count:
        yield from flush()


def _list_sizes(lists: pa.Array) -> np.ndarray:
    """The number of elements of each list; null is none."""
    if not len(lists):
        return np.zeros(0, np.int64)
    return np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.diff(lists.offsets.to_numpy()))


WIDTH = 2 * LENGTH


def shared(doc: np.ndarray, at: np.ndarray, right: np.ndarray, right_lcp: np.ndarray, n_right: np.ndarray, left: np.ndarray, left_lcp: np.ndarray, n_left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context of a gram, how far to the left and right of its anchor it agrees with earlier ones.

    right and left are the sorted orders of the suffixes and of the reversed prefixes, the others the common prefixes of
    neighbours in them and the bytes each context has on that side. Common prefixes count the padding beyond the texts'
    ends, so each pair's is cut to the shorter of the two contexts first. Only earlier contexts that share LENGTH bytes
    about the anchor count; 0, 0 without any.
    """
    n = len(doc)
    both = []
    for order, lcp, size in ((right, right_lcp, n_right), (left, left_lcp, n_left)):
        pair = np.zeros((n, n), np.int64)
        for k in range(n - 1):
            run = np.minimum.accumulate(lcp[k + 1 :])
            pair[order[k], order[k + 1 :]] = run
            pair[order[k + 1 :], order[k]] = run
        both.append(np.minimum(pair, np.minimum(size[:, None], size[None, :])))
    earlier = (doc[None, :] < doc[:, None]) | ((doc[None, :] == doc[:, None]) & (at[None, :] < at[:, None]))
    ok = earlier & (both[0] + both[1] >= LENGTH)
    return np.where(ok, both[1], 0).max(axis=1), np.where(ok, both[0], 0).max(axis=1)


def _spans(batches):
    kinds = [("doc", _L), ("a", _L), ("b", _L)]
    for t in _by_key(batches, HELD_BYTES, "bytes"):
        key, c, kind, doc, a, b, lo = (t.column(k).to_numpy() for k, _ in TEXT_TYPES[:-1])
        s = kind == SPAN
        if s.any():
            yield _batch(kinds, {"doc": doc[s], "a": a[s], "b": b[s]})
        s = np.flatnonzero(kind == ASK_WINDOWS)
        if len(s):
            order, earliest, _ = settle(key[s], c[s], doc[s], a[s])
            gone = s[order[~earliest]]
            d, x, y = merge(doc[gone], a[gone], b[gone])
            yield _batch(kinds, {"doc": d, "a": x, "b": y})
        s = np.flatnonzero(kind == ASK)
        if not len(s):
            continue
        key, doc, a, b, lo = (x[s] for x in (key, doc, a, b, lo.astype(np.int64)))
        context = t.column("context").take(pa.array(s)).to_pylist()
        group = key.view(U)
        right, right_lcp = deep_shallow(group, [x[k:] for x, k in zip(context, lo, strict=True)], WIDTH)
        left, left_lcp = deep_shallow(group, [x[:k][::-1] for x, k in zip(context, lo, strict=True)], WIDTH)
        length, anchor = b - a, a + lo
        out_doc, out_a, out_b = [], [], []
        cuts = np.flatnonzero(_runs(group[right]))
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(s)], strict=True):
            if y - x < 2:
                continue
            r, rl = right[x:y], right_lcp[x:y]
            members = np.sort(r)
            place = lambda o: np.searchsorted(members, o)
            n_left, n_right = shared(doc[members], anchor[members], place(r), rl, length[members] - lo[members], place(left[x:y]), left_lcp[x:y], lo[members])
            hit = n_left + n_right >= LENGTH
            gone = members[hit]
            out_doc.append(doc[gone])
            out_a.append(anchor[gone] - n_left[hit])
            out_b.append(anchor[gone] + n_right[hit])
        if out_doc:
            d, x, y = merge(np.concatenate(out_doc), np.concatenate(out_a), np.concatenate(out_b))
            yield _batch(kinds, {"doc": d, "a": x, "b": y})


def _cutter(keep_text: bool, first: str):
    def run(batches):
        for batch in batches:
            for piece in tx.slices(batch, "text"):
                data, offsets = tx.flat(piece.column("text"))
                gone = piece.column("gone")
                counts = _list_sizes(gone)
                a, b = (x.to_numpy() for x in gone.flatten().flatten())
                row, a, b = merge(np.repeat(np.arange(piece.num_rows), counts), a, b)
                removed = np.bincount(row, b - a, piece.num_rows).astype(np.int64)
                at = np.searchsorted(row, np.arange(piece.num_rows + 1))
                raw, hashes, texts, lists = data.tobytes(), [], [], []
                for r in range(piece.num_rows):
                    begin, parts = int(offsets[r]), []
                    place = begin
                    for k in range(at[r], at[r + 1]):
                        parts.append(raw[place : begin + int(a[k])])
                        place = begin + int(b[k])
                    parts.append(raw[place : int(offsets[r + 1])])
                    kept = b"".join(parts)
                    hashes.append(hashlib.sha256(kept).hexdigest())
                    if keep_text:
                        texts.append(kept)
                        lists.append([{"start": int(a[k]), "stop": int(b[k])} for k in range(at[r], at[r + 1])])
                columns = [piece.column("doc"), pa.array(np.diff(offsets)), pa.array(removed), pa.array(np.diff(at).astype(np.int64)), pa.array(hashes)]
                names = [first, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if keep_text:
                    columns += [pa.array(texts, pa.binary()), pa.array(lists, pa.list_(pa.struct([("start", _L), ("stop", _L)])))]
                    names += ["kept", "spans"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """doc (a number that ascends as ids do) and text of every row; and the ids of the numbers, if they are others.

    Numbers are the ids themselves unless ids repeat or are null. Then rows are numbered by id (nulls first) and text;
    equal rows share a number, and rows of different texts under one id count as documents one after the other.
    """
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        return docs.select(F.col("doc_id").alias("doc"), "text"), None
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", "text", F.sha2(text, 256).alias("sha"))
    ranked = keyed.select("doc_id", "sha").distinct().repartitionByRange("doc_id", "sha").sortWithinPartitions("doc_id", "sha")
    numbers = stage(ranked.select(F.monotonically_increasing_id().alias("doc"), "doc_id", F.col("sha").alias("__sha")), "numbers")
    named = numbers.withColumnRenamed("doc_id", "__id")
    texts = stage(keyed.join(named, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("sha") == F.col("__sha"))).select("doc", "text"), "numbered")
    return texts, numbers.select("doc", "doc_id")


def remove_repeats(docs: DataFrame, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans and kept_sha256; with keep_text, kept and spans.

    kept is what remains of the text's UTF-8 bytes (it may split a character, so it is binary) and spans are the removed
    runs. Null and empty texts have no bytes. Earlier means a smaller id (null before all), or the same document and a
    smaller start. Equal rows under one id are one document and fare alike; different texts under one id count as
    documents in the order of their SHA-256. Other columns are ignored.
    """
    texts, numbers = _numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    places = arrow_map(texts, _places, PLACES).repartition("key").sortWithinPartitions("key")
    orders = stage(arrow_map(places, _orders, ORDERS), "orders")
    asked = orders.where(F.col("kind") != SPAN).groupBy("doc").agg(F.collect_list(F.struct("kind", "key", "a", "b", "lo")).alias("asked"))
    # both joins with the texts are outer and take the same columns, so that the texts are shuffled once for both
    wanted = texts.join(asked, "doc", "left").select("doc", "text", "asked")
    contexts = arrow_map(wanted, _contexts, TEXTS).repartition("key").sortWithinPartitions("key")
    spans = orders.where(F.col("kind") == SPAN).select("doc", "a", "b").unionByName(arrow_map(contexts, _spans, "doc long, a long, b long"))
    gone = spans.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    joined = texts.join(gone, "doc", "left").select("doc", "text", "gone")
    kept = ", kept binary, spans array<struct<start long, stop long>>" if keep_text else ""
    first = "doc_id" if numbers is None else "doc"
    out = arrow_map(joined, _cutter(keep_text, first), f"{first} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{kept}")
    if numbers is None:
        return out
    return out.join(numbers, "doc").select("doc_id", *[c for c in out.columns if c != "doc"])
