"""Rotated codes: 1-bit signs with bounds, 4-bit magnitudes, and block residuals of either.

A vector minus the centre is normalised, padded to a power of two, its signs
flipped by a seeded pattern, and rotated by the Walsh-Hadamard transform. The
magnitudes 0 to 7 come from the scale whose code has the largest cosine with the
rotated vector, of all scales. Distances to a rotated query follow from the codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.search import matrix, scan

ENCODED = "vec_id bigint, norm_sqr double, long_scale double, short_scale double, error_scale double, codes array<int>, res_scale array<double>, res_codes array<int>"
EPSILON = 1.9
BLOCK = 16


def padded(dim: int) -> int:
    return max(64, 1 << (dim - 1).bit_length())


def signs(n: int, seed: int) -> np.ndarray:
    return np.where(np.random.default_rng(seed).random(n) < 0.5, -1.0, 1.0)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of rows of a power of two, not normalised."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Sign flips and the Walsh-Hadamard transform, which keep lengths; seed 0 leaves vectors as they are."""
    n = padded(x.shape[1])
    out = np.zeros((len(x), n))
    out[:, : x.shape[1]] = x
    if seed == 0:
        return out
    return hadamard(out * signs(n, seed)) / np.sqrt(n)


def double_rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Two rounds of sign flips and transforms over the largest power of two that fits, of the first and of the last values, so that no padding is needed."""
    dim = x.shape[1]
    n = 1 << (dim.bit_length() - 1)
    out = np.array(x, dtype=np.float64)
    for turn, part in enumerate((slice(0, n), slice(dim - n, dim))):
        out[:, part] = hadamard(out[:, part] * signs(n, seed + turn)) / np.sqrt(n)
    return out


def random_rotation(x: np.ndarray, seed: int) -> np.ndarray:
    """A rotation drawn uniformly: the orthogonal factor of a Gaussian matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((x.shape[1], x.shape[1])))
    return x @ (q * np.sign(np.diag(r))[None])


#: Transforms by name; ``none`` leaves vectors as they are.
TRANSFORMS = {"padding_hadamard": rotate, "double_hadamard": double_rotate, "random_rotation": random_rotation, "none": lambda x, seed: np.asarray(x, dtype=np.float64)}


def magnitudes(u: np.ndarray, levels: int = 8) -> np.ndarray:
    """Integers m for |u| for which m + 1/2 has the largest cosine with |u|, of all that one scale can give.

    As the scale grows, values pass thresholds one after the other, and each
    passing adds one to a magnitude; running sums give the cosine after each.
    """
    a = np.abs(u)
    n, dim = a.shape
    # value a passes to magnitude j at scale j / a; in rising order of the scale
    steps = np.arange(1, levels)
    at = (steps[None, None] / np.maximum(a, 1e-300)[:, :, None]).reshape(n, -1)
    order = np.argsort(at, axis=1, kind="stable")
    owner, level = order // (levels - 1), order % (levels - 1) + 1
    dot = 0.5 * a.sum(axis=1, keepdims=True) + np.cumsum(np.take_along_axis(a, owner, axis=1), axis=1)
    size = 0.25 * dim + np.cumsum(2.0 * level, axis=1)  # (j + 1/2)^2 - (j - 1/2)^2 = 2 j
    first = 0.5 * a.sum(axis=1, keepdims=True) / np.sqrt(0.25 * dim)
    cosine = np.hstack([first, dot / np.sqrt(size)])
    taken = cosine.argmax(axis=1)
    out = np.zeros(a.shape, dtype=np.int64)
    rows = np.repeat(np.arange(n), taken)
    places = np.concatenate([owner[i, :t] for i, t in enumerate(taken)]) if n else np.empty(0, dtype=int)
    np.add.at(out, (rows, places), 1)
    return out


def error_scale(u: np.ndarray, norm: np.ndarray, rule: str = "projection") -> np.ndarray:
    """Factors of the bounds of 1-bit estimates, for unit vectors u and lengths ``norm``.

    ``projection``: what the signs leave of the vector, a bound that always
    holds. ``probabilistic``: as far as the error goes with a probability given
    by a constant number of deviations, 5.75 / 16, for a cosine o of the vector
    with its signs: sqrt((1 - o^2) / o^2) * 5.75 / 16 / sqrt(dim) * 2 * norm.
    """
    dim = u.shape[1]
    cosine = np.abs(u).sum(axis=1) / np.sqrt(dim)
    if rule == "projection":
        return np.sqrt(np.maximum(0, 1 - cosine**2)) * norm
    o = np.clip(cosine, 1e-6, 0.999999)
    return np.sqrt((1 - o**2) / o**2) * 5.75 / 16 / np.sqrt(dim) * 2 * norm


def encode(x: np.ndarray, centre: np.ndarray, seed: int, bits: int, error_rule: str = "projection", fit: str = "largest") -> dict[str, np.ndarray]:
    """Codes and factors of a batch; ``bits`` of residual a value, 0 for none, on the scale of a block's ``largest`` value or of least ``mse``."""
    r = x - centre
    norm = np.linalg.norm(r, axis=1)
    u = rotate(r / np.maximum(norm, 1e-300)[:, None], seed)
    m = magnitudes(u)
    codes = np.where(u > 0, 8 + m, 7 - m)
    long_scale = norm / np.maximum(((m + 0.5) * np.abs(u)).sum(axis=1), 1e-300)
    short_scale = norm / np.maximum(np.abs(u).sum(axis=1), 1e-300)
    out = {"norm_sqr": norm**2, "long_scale": long_scale, "short_scale": short_scale, "error_scale": error_scale(u, norm, error_rule), "codes": codes}
    res = u * norm[:, None] - long_scale[:, None] * (codes - 7.5)
    if bits:
        blocks = res.reshape(len(x), -1, BLOCK)
        q = max(1, 2 ** (bits - 1) - 1)
        scale = np.abs(blocks).max(axis=2) / q if bits > 1 else np.abs(blocks).mean(axis=2)
        coded = np.clip(np.rint(blocks / np.maximum(scale, 1e-300)[:, :, None]), -q, q) if bits > 1 else np.where(blocks > 0, 1, -1)
        if fit == "mse":  # the scale that fits the codes best, in turns with the codes that fit the scale
            for _ in range(4 if bits > 1 else 1):
                scale = np.maximum((coded * blocks).sum(axis=2) / np.maximum((coded * coded).sum(axis=2), 1e-300), 0)
                if bits > 1:
                    coded = np.clip(np.rint(blocks / np.maximum(scale, 1e-300)[:, :, None]), -q, q)
        out |= {"res_scale": scale, "res_codes": coded.reshape(len(x), -1).astype(np.int64)}
    return out


def distances(e: dict[str, np.ndarray], q: np.ndarray, centre: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """For one query: 4-bit estimate, residual-corrected estimate, 1-bit estimate with bounds and the probable lower bound."""
    y = rotate((q - centre)[None], seed)[0]
    both = e["norm_sqr"] + float(y @ y)
    coarse = both - 2 * e["long_scale"] * ((e["codes"] - 7.5) @ y)
    out = {"long": coarse}
    if "res_codes" in e:
        parts = (e["res_codes"].reshape(len(coarse), -1, BLOCK) * y.reshape(-1, BLOCK)).sum(axis=2)
        out["corrected"] = coarse - 2 * (e["res_scale"] * parts).sum(axis=1)
    dim = len(y)
    sign_ip = np.where(e["codes"] >= 8, 1.0, -1.0) @ y
    out["short"] = both - 2 * e["short_scale"] * sign_ip
    err = 2 * e["error_scale"] * np.linalg.norm(y)
    out["short_low"], out["short_high"] = out["short"] - err, out["short"] + err
    out["gate"] = gate(e["norm_sqr"], e["short_scale"], sign_ip, np.linalg.norm(y), dim)
    out["hard_low"] = hard_bound(e, y)
    return out


def gate(norm_sqr: np.ndarray, short_scale: np.ndarray, sign_ip: np.ndarray, size: float, dim: int) -> np.ndarray:
    """Probable lower bounds of distances from signs. Where a norm or scale is zero there is no bound: minus infinity."""
    norm = np.sqrt(norm_sqr)
    both = norm_sqr + size**2
    valid = (norm > 0) & (short_scale > 0) & (size > 0)
    # the cosine of a vector with its signs
    alpha = np.clip(norm / np.maximum(short_scale * np.sqrt(dim), 1e-300), 1e-300, 1)
    guess = sign_ip / np.sqrt(dim) / max(size, 1e-300) / alpha
    slack = np.sqrt(np.maximum(0, 1 - alpha**2)) / alpha * EPSILON / np.sqrt(max(dim - 1, 1))
    return np.where(valid, both - 2 * norm * size * np.maximum(-1, np.minimum(1, guess + slack)), -np.inf)


def hard_bound(e: dict[str, np.ndarray], y: np.ndarray) -> np.ndarray:
    """Lower bounds of distances that always hold: a vector with these signs lies at most at an angle with the query that its cosines with the signs allow."""
    norm, size, dim = np.sqrt(e["norm_sqr"]), np.linalg.norm(y), len(y)
    signs = np.where(e["codes"] >= 8, 1.0, -1.0) / np.sqrt(dim)
    a = np.clip(norm / np.maximum(e["short_scale"] * np.sqrt(dim), 1e-300), 0, 1)
    b = np.clip(signs @ y / max(size, 1e-300), -1, 1)
    # the largest cosine of the sum of two angles to one direction
    best = np.where(a >= 1, b, np.minimum(1, a * b + np.sqrt(np.maximum(0, 1 - a * a)) * np.sqrt(np.maximum(0, 1 - b * b))))
    return e["norm_sqr"] + size**2 - 2 * norm * size * best


def between_codes(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """Symmetric estimates of squared distances (row of a, row of b) from codes of one centre and rotation alone."""
    x, y = a["long_scale"][:, None] * (a["codes"] - 7.5), b["long_scale"][:, None] * (b["codes"] - 7.5)
    return np.maximum(a["norm_sqr"][:, None] + b["norm_sqr"][None] - 2 * x @ y.T, 0)


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """4-bit codes as bytes, the first of two in the low half."""
    c = codes.astype(np.uint8)
    return c[:, 0::2] | (c[:, 1::2] << 4)


def unpack_codes(packed: np.ndarray) -> np.ndarray:
    return np.stack([packed & 15, packed >> 4], axis=2).reshape(len(packed), -1).astype(np.int64)


def nested_layout(codes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """8-bit codes of 4 coarse bits above 4 finer ones; the coarse code is what remains without the lower half."""
    return (codes.astype(np.uint8) << 4) | more.astype(np.uint8)


def encode_table(vectors: DataFrame, centre: list[float], seed: int = 1, bits: int = 8) -> DataFrame:
    """ENCODED rows of (vec_id, vec)."""
    c = np.asarray(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column("vec").to_numpy(zero_copy_only=False)).astype(np.float64)
                e = encode(x, c, seed, bits)
                e.setdefault("res_scale", np.zeros((len(x), 0)))
                e.setdefault("res_codes", np.zeros((len(x), 0), dtype=np.int64))
                lists = lambda k, t: pa.array(list(e[k]), pa.list_(t))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), *(pa.array(e[k]) for k in ("norm_sqr", "long_scale", "short_scale", "error_scale")), lists("codes", pa.int32()), lists("res_scale", pa.float64()), lists("res_codes", pa.int32())], ["vec_id", "norm_sqr", "long_scale", "short_scale", "error_scale", "codes", "res_scale", "res_codes"])

    return vectors.select("vec_id", "vec").mapInArrow(run, ENCODED)


def _columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The codes and factors of a batch of ENCODED rows."""
    e = {k: b.column(k).to_numpy() for k in ("norm_sqr", "long_scale", "short_scale", "error_scale")}
    for k in ("codes", "res_scale", "res_codes"):
        e[k] = matrix(b.column(k), b.num_rows)
    if not e["res_codes"].shape[1]:
        del e["res_codes"]
    return e


def search(encoded: DataFrame, queries: DataFrame, centre: list[float], k: int, seed: int = 1, by: str = "long", gated: bool = False, own: bool = True) -> DataFrame:
    """Top k by an estimate: ``long`` (4 bits) or ``short`` (signs). Queries are rotated once a task, and a task gives k rows a query.

    With ``gated``, rows whose probable lower bound is above the k-th best estimate of their batch get no estimate from all bits.
    """
    c = np.asarray(centre)

    def prepare(q: np.ndarray) -> np.ndarray:
        return rotate(q - c, seed)

    def score(y: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        e = _columns(b)
        both = e["norm_sqr"][None] + np.square(y).sum(axis=1)[:, None]
        signs = np.where(e["codes"] >= 8, 1.0, -1.0)
        if by == "short":
            return both - 2 * e["short_scale"][None] * (y @ signs.T)
        if not gated:
            return both - 2 * e["long_scale"][None] * (y @ (e["codes"] - 7.5).T)
        out = np.full(both.shape, np.inf)
        for i, one in enumerate(y):
            sign_ip = signs @ one
            low = gate(e["norm_sqr"], e["short_scale"], sign_ip, np.linalg.norm(one), len(one))
            # best first by signs, so that k estimates give a bar for the others
            first = np.argsort(both[i] - 2 * e["short_scale"] * sign_ip)[:k]
            estimate = lambda at, one=one, i=i: both[i, at] - 2 * e["long_scale"][at] * ((e["codes"][at] - 7.5) @ one)
            out[i, first] = estimate(first)
            left = np.setdiff1d(np.flatnonzero(low <= out[i, first].max()), first)
            out[i, left] = estimate(left)
        return out

    return scan(queries, encoded, k, score, prepare, own=own)


NAMES = ("long", "corrected", "short", "short_low", "short_high", "gate", "hard_low")


def rescore(pairs: DataFrame, encoded: DataFrame, queries: DataFrame, centre: list[float], seed: int = 1) -> DataFrame:
    """All estimates of the pairs (query_id, vec_id), ``dist`` being the one from residuals where there are any."""
    c = np.asarray(centre)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        e = {k: group[k].to_numpy() for k in ("norm_sqr", "long_scale", "short_scale", "error_scale")}
        for k in ("codes", "res_scale", "res_codes"):
            e[k] = np.stack(group[k])
        if not e["res_codes"].shape[1]:
            del e["res_codes"]
        d = distances(e, np.asarray(group["qvec"].iloc[0], dtype=np.float64), c, seed)
        return pd.DataFrame({"query_id": group["query_id"], "vec_id": group["vec_id"], **{n: d.get(n, d["long"]) for n in NAMES}, "dist": d.get("corrected", d["long"])})

    rows = pairs.join(encoded, "vec_id").join(queries.select("query_id", "qvec"), "query_id")
    return rows.groupBy("query_id").applyInPandas(run, "query_id bigint, vec_id bigint, " + ", ".join(f"{n} double" for n in (*NAMES, "dist")))
