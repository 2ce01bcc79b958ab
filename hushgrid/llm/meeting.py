"""Keys that several rows have, found without sending all rows of a frequent key to one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shingles import mixed

#: kind 1: a row whose key its sender has once; 2: a key that its sender has several times; 0: a row with such a key.
ROUTED = "route long, kind int, key long, id long"
CHUNK = 500_000  # rows of a batch


def routed(keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (route, kind, key, id) for keys and the ids that have them, both 64-bit integers, as one task knows them.

    A key that stands here once goes where its route leads. One that stands here several times is repeated whatever
    others have: a single row says so on its route, and its ids go past that, each by a route of its own.
    """
    keys, ids = keys.view(np.int64), ids.view(np.int64)
    own, index, count = np.unique(keys, return_inverse=True, return_counts=True)
    several = count[index] > 1
    known, sent, whose = own[count > 1], keys[several], ids[several]
    if len(sent):
        order = np.lexsort((whose, sent))
        sent, whose = sent[order], whose[order]
        new = np.concatenate(([True], (sent[1:] != sent[:-1]) | (whose[1:] != whose[:-1])))
        sent, whose = sent[new], whose[new]
    apart = mixed(sent.view(np.uint64) ^ mixed(whose.view(np.uint64))).view(np.int64)
    columns = [
        np.concatenate([keys[~several], known, apart]),
        np.repeat(np.array([1, 2, 0], np.int32), [len(keys) - several.sum(), len(known), len(sent)]),
        np.concatenate([keys[~several], known, sent]),
        np.concatenate([ids[~several], np.zeros(len(known), np.int64), whose]),
    ]
    for at in range(0, len(columns[0]), CHUNK):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + CHUNK]) for c in columns], ["route", "kind", "key", "id"])


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id) of those rows of ROUTED, sorted by key, whose key is repeated: all of kind 0, and those of kind 1 that
    meet another row of kind 1 or 2."""

    def decided(kind: np.ndarray, key: np.ndarray, id_: np.ndarray) -> pa.RecordBatch:
        own, index = np.unique(key, return_inverse=True)
        n = np.bincount(index, weights=kind, minlength=len(own))[index]
        kept = (kind == 0) | ((kind == 1) & (n > 1))
        return pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array(id_[kept])], ["key", "id"])

    rest = [np.empty(0, np.int64)] * 3
    for batch in batches:
        whole = [np.concatenate([r, batch.column(i).to_numpy()]) for r, i in zip(rest, (1, 2, 3), strict=True)]
        if not len(whole[1]):
            continue
        ready = whole[1] != whole[1][-1]
        rest = [w[~ready] for w in whole]
        yield decided(*(w[ready] for w in whole))
    if len(rest[1]):
        yield decided(*rest)
