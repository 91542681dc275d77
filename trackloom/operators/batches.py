"""Groups of rows inside the batches of a sorted partition."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd


def starts(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """The first row of each group of neighbours with equal keys; a null is a key like any other."""
    new = np.ones(len(pdf), bool)
    new[1:] = False
    for k in keys:
        x = pdf[k].to_numpy()
        none = pd.isna(x)
        new[1:] |= (x[1:] != x[:-1]) & ~(none[1:] & none[:-1])
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """The same rows in batches that end where a group ends. A group longer than a batch is held whole."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        if held and len(starts(pd.concat([held[-1].iloc[-1:], pdf.iloc[:1]]), keys)) == 2:
            yield pd.concat(held, ignore_index=True)
            held = []
        last = int(starts(pdf, keys)[-1])
        if last:
            yield pd.concat([*held, pdf.iloc[:last]], ignore_index=True)
            held = []
        held.append(pdf.iloc[last:])
    if held:
        yield pd.concat(held, ignore_index=True)
