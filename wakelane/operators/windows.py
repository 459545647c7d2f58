"""Window and signal features over sliding frames (2.C)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakelane.operators.primitives import sliding_frames

BINS = 50
BAND = (0.5, 30.0)
#: GHM multiwavelet filter taps (fixed values): four 2x2 matrices, low-pass and high-pass.
_R = 2**0.5
GHM_LOW = np.array([[[3 / (5 * _R), 4 / (5 * _R)], [-1 / (20 * _R), -3 / (20 * _R)]], [[3 / (5 * _R), 0], [9 / (20 * _R), 1 / _R]], [[0, 0], [9 / (20 * _R), -3 / (20 * _R)]], [[0, 0], [-1 / (20 * _R), 0]]])
GHM_HIGH = np.array([[[-1 / (20 * _R), 3 / (20 * _R)], [3 / (5 * _R), -4 / (5 * _R)]], [[9 / (20 * _R), -1 / _R], [-3 / (5 * _R), 0]], [[9 / (20 * _R), 3 / (20 * _R)], [0, 0]], [[-1 / (20 * _R), 0], [0, 0]]])


def gradient(df: DataFrame, keys: Sequence[str], x: str, rate: float = 1.0, idx: str = "idx", name: str = "gradient") -> DataFrame:
    """Central difference times rate, one-sided at both ends."""
    w = Window.partitionBy(*keys).orderBy(idx)
    back, ahead = F.lag(x).over(w), F.lead(x).over(w)
    g = F.when(back.isNull(), ahead - F.col(x)).when(ahead.isNull(), F.col(x) - back).otherwise((ahead - back) / 2)
    return df.withColumn(name, g * rate)


def nan_to_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN and null become 0."""
    return df.select(*(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)).alias(c) if c in columns else c for c in df.columns))


def gaussian_smooth(df: DataFrame, keys: Sequence[str], x: str, sigma: float = 10.0, idx: str = "idx", name: str = "smooth") -> DataFrame:
    """Gaussian weights cut at 4 sigma, series reflected at both ends (d c b a | a b c d | d c b a).

    One sort by key: a frame of radius rows on both sides holds every value that
    a row needs, since a reflected place is never farther away than the radius.
    idx numbers the rows of a key from 0.
    """
    radius = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights = weights / weights.sum()
    order = Window.partitionBy(*keys).orderBy(idx)
    rows = df.withColumn("_near", F.collect_list(x).over(order.rowsBetween(-radius, radius))).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    first = F.greatest(F.col(idx) - radius, F.lit(0))

    def value(w: Column, k: Column) -> Column:
        place = F.pmod(F.col(idx) + k - radius, 2 * F.col("_n"))
        folded = F.when(place < F.col("_n"), place).otherwise(2 * F.col("_n") - 1 - place)
        return w * F.get("_near", (folded - first).cast("int"))

    parts = F.transform(F.array(*map(F.lit, weights.tolist())), value)
    return rows.withColumn(name, F.aggregate(parts, F.lit(0.0), lambda t, v: t + v)).drop("_near", "_n")


def _with_steps(frames: DataFrame, keys: Sequence[str], x: str, idx: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(idx)
    whole = Window.partitionBy(*keys)
    first = F.min_by(x, idx).over(whole)
    return frames.select("*", F.lag(x).over(w).alias("_prev"), first.alias("_first"), F.min(idx).over(whole).alias("_i0"), F.min(x).over(whole).alias("_lo"), F.max(x).over(whole).alias("_hi"))


def moments(x: str) -> list[Column]:
    """C4: mean, population variance and deviation, extremes, range, energy."""
    return [F.avg(x).alias("mean"), F.var_pop(x).alias("variance"), F.stddev_pop(x).alias("std_dev"), F.max(x).alias("max"), F.min(x).alias("min"), (F.max(x) - F.min(x)).alias("range"), F.sum(F.col(x) * F.col(x)).alias("energy")]


def quartiles(x: str) -> list[Column]:
    """Exact quartiles with linear interpolation."""
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [q[0].alias("quartile25"), q[1].alias("median"), q[2].alias("quartile75")]


def skew_kurt(x: str) -> list[Column]:
    """Biased skewness and excess kurtosis, 0 for constant windows."""
    flat = F.max(x) == F.min(x)
    return [F.when(flat, 0.0).otherwise(F.skewness(x)).alias("skewness"), F.when(flat, 0.0).otherwise(F.kurtosis(x)).alias("kurtosis")]


def window_features(frames: DataFrame, keys: Sequence[str], x: str = "x", idx: str = "idx") -> DataFrame:
    """C4-C8 in one grouped pass: moments, zero crossings, quartiles, shape, Katz dimension."""
    rows = _with_steps(frames, keys, x, idx)
    step = F.abs(F.col(x) - F.col("_prev"))
    crossed = F.when(F.col("_prev").isNotNull(), (F.signum(x) != F.signum("_prev")).cast("int"))
    far = F.sqrt(F.pow(F.col(idx) - F.col("_i0"), 2) + F.pow(F.col(x) - F.col("_first"), 2))
    length, span = F.sum(step), F.max(far)
    katz = F.when((F.count("*") < 2) | (length == 0) | (span == 0) | (span == 1), 0.0).otherwise(F.log10(length) / F.log10(span))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *moments(x), F.avg(crossed).alias("zero_crossing_rate"), *quartiles(x), *skew_kurt(x), katz.alias("katz_fd"))


def shannon_entropy(frames: DataFrame, keys: Sequence[str], x: str = "x", bins: int = BINS) -> DataFrame:
    """Entropy (bits) over equal-width bins between a window's extremes, the last one closed."""
    edges = frames.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count("*").alias("_n"))
    cell = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(x) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)), F.lit(bins - 1))).otherwise(0)
    p = F.col("_c") / F.col("_n")
    return frames.join(edges, list(keys)).groupBy(*keys, "_n", cell.alias("_b")).agg(F.count("*").alias("_c")).groupBy(*keys).agg(F.greatest(F.lit(0.0), -F.sum(p * F.log2(p))).alias("shannon_entropy"))


#: Columns of time_statistics() besides the count.
TIME = ("mean", "variance", "std_dev", "max", "min", "range", "energy", "zero_crossing_rate", "quartile25", "median", "quartile75", "skewness", "kurtosis", "katz_fd")


def sample_entropies(x: np.ndarray, m: int = 2, share: float = 0.2) -> np.ndarray:
    """C10 of each row: -log of matches of length m+1 over matches of length m.

    A match is a pair of templates nowhere farther apart than share * sigma; 0
    for constant or short series, 10 where either count is zero. Work is
    quadratic in the window, one lag at a time for all rows together.
    """
    n, r = x.shape[1], share * x.std(axis=1, keepdims=True)
    counts = np.zeros((2, len(x)))
    for lag in range(1, n - m + 1):
        close = np.abs(x[:, lag:] - x[:, :-lag]) <= r
        same = np.logical_and.reduce([close[:, k : close.shape[1] - m + 1 + k] for k in range(m)])
        counts[0] += same.sum(1)
        counts[1] += (same[:, :-1] & close[:, m:]).sum(1)
    some = (counts > 0).all(0)
    out = np.where(some, -np.log(np.where(some, counts[1], 1) / np.where(some, counts[0], 1)), 10.0)
    return np.where((r[:, 0] == 0) | (n <= m + 1), 0.0, out)


def sample_entropy_of(x: np.ndarray, m: int = 2, share: float = 0.2) -> float:
    """C10 for one series."""
    return float(sample_entropies(x[None], m, share)[0])


def spectra(x: np.ndarray, rate: float) -> dict[str, np.ndarray]:
    """C11 of each row: spread, entropy, flux, centre of gravity, dominant frequency, mean power."""
    eps = np.finfo(float).eps
    f, power = np.fft.fftfreq(x.shape[1], 1 / rate), np.abs(np.fft.fft(x, axis=1)) ** 2
    band = (f >= BAND[0]) & (f <= BAND[1])
    inside, some, none = power[:, band], band.any(), np.zeros(len(x))
    total = inside.sum(1) + eps
    p = inside / total[:, None]
    return {
        "freq_var": np.full(len(x), f[band].var()) if some else none,
        "spectral_entropy": -(p * np.log2(p + eps)).sum(1),
        "spectral_flux": np.sqrt((np.diff(power, axis=1) ** 2).sum(1)),
        "freq_cog": (inside * f[band]).sum(1) / total,
        "dominant_freq": f[power.argmax(1)],
        "avg_psd": inside.mean(1) if some else none,
    }


def spectral_of(x: np.ndarray, rate: float) -> dict[str, float]:
    """C11 for one series."""
    return {k: float(v[0]) for k, v in spectra(x[None], rate).items()}


def multiwavelets(x: np.ndarray, levels: int = 3) -> np.ndarray:
    """C14 of each row: relative band energies of a GHM packet, highest band first."""
    x = x[:, : x.shape[1] // 2 * 2]
    nodes = [np.stack([x[:, 0::2], x[:, 1::2]], 1)]
    for _ in range(levels):
        grown = []
        for node in nodes:
            if node.shape[2] < 4:
                grown += [node, np.zeros_like(node)]
                continue
            n = node.shape[2] // 2
            padded = np.concatenate([node, np.zeros((len(x), 2, 4))], 2)
            taps = [padded[:, :, k : k + 2 * n : 2] for k in range(4)]
            grown += [sum(c @ t for c, t in zip(bank, taps)) for bank in (GHM_LOW, GHM_HIGH)]
        nodes = grown
    energy = np.stack([(node**2).mean((1, 2)) if node.size else np.zeros(len(x)) for node in reversed(nodes)], 1)
    return energy / (energy.sum(1, keepdims=True) + 1e-10)


def multiwavelet_of(x: np.ndarray, levels: int = 3) -> list[float]:
    """C14 for one series."""
    return multiwavelets(x[None], levels)[0].tolist()


def shannon_entropies(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """C9 of each row."""
    lo, hi = x.min(1, keepdims=True), x.max(1, keepdims=True)
    cell = np.where(hi > lo, np.minimum(np.floor((x - lo) / np.where(hi > lo, (hi - lo) / bins, 1.0)), bins - 1), 0).astype(np.int64)
    c = np.bincount((np.arange(len(x))[:, None] * bins + cell).ravel(), minlength=len(x) * bins).reshape(len(x), bins) / x.shape[1]
    return np.maximum(0.0, -(c * np.log2(np.where(c > 0, c, 1.0))).sum(1))


def time_statistics(x: np.ndarray) -> dict[str, np.ndarray]:
    """C4-C8 of each row: moments, zero crossings, quartiles, shape, Katz dimension."""
    n, mean = x.shape[1], x.mean(1)
    lo, hi = x.min(1), x.max(1)
    z = x - mean[:, None]
    var = (z * z).mean(1)
    flat = hi == lo
    safe = np.where(flat, 1.0, var)
    q = np.percentile(x, (25, 50, 75), axis=1)
    crossed = np.diff(np.sign(x), axis=1) != 0
    length = np.abs(np.diff(x, axis=1)).sum(1)
    span = np.sqrt(np.arange(n)[None] ** 2 + (x - x[:, :1]) ** 2).max(1)
    usable = (length > 0) & (span > 0) & (span != 1) & (n >= 2)
    katz = np.where(usable, np.log10(np.where(usable, length, 1.0)) / np.log10(np.where(usable, span, 10.0)), 0.0)
    return {
        "n": np.full(len(x), n),
        "mean": mean,
        "variance": var,
        "std_dev": np.sqrt(var),
        "max": hi,
        "min": lo,
        "range": hi - lo,
        "energy": (x * x).sum(1),
        "zero_crossing_rate": crossed.mean(1) if n > 1 else np.full(len(x), np.nan),
        "quartile25": q[0],
        "median": q[1],
        "quartile75": q[2],
        "skewness": np.where(flat, 0.0, (z**3).mean(1) / safe**1.5),
        "kurtosis": np.where(flat, 0.0, (z**4).mean(1) / safe**2 - 3),
        "katz_fd": katz,
    }


def per_window(frames: DataFrame, keys: Sequence[str], fn, schema: str, x: str = "x", idx: str = "idx") -> DataFrame:
    """Applies fn (matrix of windows by samples -> column name -> values) to all windows, in order of idx.

    Rows are partitioned by window and sorted; each Arrow batch is reshaped, so
    that one call serves all windows of one length in it. The window that a
    batch ends in waits for the next batch.
    """
    types = dict(frames.dtypes)
    fields = [f.strip().split(" ") for f in schema.split(",")]
    arrow = {"double": pa.float64(), "long": pa.int64()}

    def windows(table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        values = table.column(x).to_numpy()
        columns = {n: np.empty(len(starts), np.int64 if t == "long" else float) for n, t in fields}
        for size in np.unique(ends - starts):
            mine = np.flatnonzero(ends - starts == size)
            got = fn(values[starts[mine][:, None] + np.arange(size)].astype(float))
            for n, column in columns.items():
                column[mine] = got[n]
        at = pa.array(starts)
        own = [table.column(k).combine_chunks().take(at) for k in keys]
        return pa.RecordBatch.from_arrays([*own, *(pa.array(columns[n], arrow[t]) for n, t in fields)], names=[*keys, *columns])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            new = np.zeros(held.num_rows - 1, bool)
            for k in keys:
                column = held.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                new |= column[1:] != column[:-1]
            edge = np.concatenate([[0], np.flatnonzero(new) + 1])
            if len(edge) > 1:
                yield windows(held, edge[:-1], edge[1:])
                held = held.slice(int(edge[-1]))
        if held is not None:
            yield windows(held, np.zeros(1, np.int64), np.array([held.num_rows]))

    rows = frames.select(*keys, idx, x).repartition(*keys).sortWithinPartitions(*keys, idx)
    return rows.mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + schema)


def sample_entropy(frames, keys, x="x", idx="idx"):
    """C10."""
    return per_window(frames, keys, lambda s: {"sample_entropy": sample_entropies(s)}, "sample_entropy double", x, idx)


SPECTRAL = "freq_var double, spectral_entropy double, spectral_flux double, freq_cog double, dominant_freq double, avg_psd double"


def spectral(frames, keys, rate: float, x="x", idx="idx"):
    """C11."""
    return per_window(frames, keys, lambda s: spectra(s, rate), SPECTRAL, x, idx)


def multiwavelet_energy(frames, keys, x="x", idx="idx"):
    """Eight relative band energies, DDD to AAA."""
    bands = ["ddd", "dda", "dad", "daa", "add", "ada", "aad", "aaa"]
    return per_window(frames, keys, lambda s: dict(zip(bands, multiwavelets(s).T)), ", ".join(f"{b} double" for b in bands), x, idx)


def time_freq_features(df: DataFrame, keys: Sequence[str], size: int, step: int, rate: float, x: str = "x", idx: str = "idx") -> DataFrame:
    """All time, entropy and frequency features of every window of every series, in one shuffle and one pass."""
    schema = "n long, " + ", ".join(f"{c} double" for c in TIME) + ", shannon_entropy double, sample_entropy double, " + SPECTRAL
    every = lambda s: {**time_statistics(s), "shannon_entropy": shannon_entropies(s), "sample_entropy": sample_entropies(s), **spectra(s, rate)}
    return per_window(sliding_frames(df, keys, size, step, idx), [*keys, "win"], every, schema, x, idx)


def smooth_std_pe(frames: DataFrame, keys: Sequence[str], x: str = "x", idx: str = "idx") -> DataFrame:
    """Deviation, mean and error of the last value against its extrapolation from the three before."""
    last = F.slice(F.transform(F.sort_array(F.collect_list(F.struct(idx, x))), lambda s: s[x]), -4, 4)
    got = frames.groupBy(*keys).agg(F.stddev_pop(x).alias("std_dev"), F.avg(x).alias("mean"), F.count("*").alias("_n"), last.alias("_l"))
    pe = F.when(F.col("_n") >= 4, F.abs(2.5 * F.col("_l")[2] - 2 * F.col("_l")[1] + 0.5 * F.col("_l")[0] - F.col("_l")[3]))
    return got.select(*keys, "std_dev", "mean", pe.alias("pred_error"))


def butterworth_sections(order: int, low: float, high: float) -> tuple[float, np.ndarray]:
    """Gain and denominators (1, a1, a2) of a band-pass of Butterworth type; every numerator is 1 - z^-2.

    low and high are shares of the Nyquist frequency. The poles of the low-pass
    prototype go to the warped band and through the bilinear transform.
    """
    w1, w2 = 4 * np.tan(np.pi * np.array([low, high]) / 2)
    proto = -np.exp(1j * np.pi * np.arange(1 - order, order, 2) / (2 * order)) * (w2 - w1) / 2
    root = np.sqrt(proto**2 - w1 * w2 + 0j)
    poles = np.concatenate([proto + root, proto - root])
    gain = (((w2 - w1) * 4) ** order / np.prod(4 - poles)).real
    z = (4 + poles) / (4 - poles)
    upper, real = z[z.imag > 1e-12], np.sort(z[np.abs(z.imag) <= 1e-12].real)
    pairs = [(-2 * p.real, abs(p) ** 2) for p in upper] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2])]
    return gain, np.array([(1.0, a1, a2) for a1, a2 in pairs])


def bandpass(x: np.ndarray, rate: float, low: float, high: float, order: int = 5) -> np.ndarray:
    """Each row filtered forwards and backwards, from the steady state of its odd extension at both ends."""
    nyquist = rate / 2
    gain, sections = butterworth_sections(order, low / nyquist, min(high / nyquist, 0.999))
    pad = min(3 * (2 * order + 1), x.shape[1] - 1)
    y = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], 1)
    for _ in range(2):
        y = y * gain
        for k, (_, a1, a2) in enumerate(sections):
            # A constant passes no section, so only the first one starts from more than zero.
            s1 = s2 = -y[:, 0] if k == 0 else np.zeros(len(y))
            out = np.empty_like(y)
            for t in range(y.shape[1]):
                v = y[:, t]
                out[:, t] = o = v + s1
                s1, s2 = s2 - a1 * o, -v - a2 * o
            y = out
        y = y[:, ::-1]
    return y[:, pad : pad + x.shape[1]]


def welch(x: np.ndarray, rate: float, length: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and power density of each row: half-overlapping, mean-free segments under a periodic Hann window."""
    size = min(length, x.shape[1])
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size) if size > 1 else np.ones(1)
    step = size - size // 2
    parts = np.stack([x[:, k : k + size] for k in range(0, x.shape[1] - size + 1, step)], 1)
    power = np.abs(np.fft.rfft((parts - parts.mean(2, keepdims=True)) * taper, axis=2)) ** 2 / (rate * (taper**2).sum())
    power[..., 1 : (size + 1) // 2] *= 2
    return np.fft.rfftfreq(size, 1 / rate), power.mean(1)


def eeg_band_power(frames: DataFrame, keys: Sequence[str], rate: float, bands: dict[str, tuple[float, float]], x="x", idx="idx"):
    """Each window band-passed (fifth order, forwards and backwards), then Welch's density summed over the band, ends included."""

    def power(s: np.ndarray) -> dict[str, np.ndarray]:
        out = {}
        for b, (lo, hi) in bands.items():
            f, density = welch(bandpass(s, rate, lo, hi), rate)
            out[b] = density[:, (f >= lo) & (f <= hi)].sum(1)
        return out

    return per_window(frames, keys, power, ", ".join(f"{b} double" for b in bands), x, idx)


def perclos(df: DataFrame, keys: Sequence[str], start: str, duration: str, window: float) -> DataFrame:
    """C17: closed share of tumbling windows from the first blink; a partial last window is dropped, empty ones are 0."""
    span = df.groupBy(*keys).agg(F.min(start).alias("_t0"), F.max(start).alias("_t1"))
    count = F.floor((F.col("_t1") - F.col("_t0")) / window)
    grid = span.where(count >= 1).select(*keys, "_t0", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("bucket"))
    closed = df.join(span, list(keys)).groupBy(*keys, F.floor((F.col(start) - F.col("_t0")) / window).alias("bucket")).agg(F.sum(duration).alias("_d"))
    return grid.join(closed, [*keys, "bucket"], "left").select(*keys, "bucket", (F.coalesce("_d", F.lit(0.0)) / window).alias("perclos"))


def tumbling_mean(df: DataFrame, keys: Sequence[str], t: str, columns: Sequence[str], window: float) -> DataFrame:
    """Means of all columns, time included, per tumbling window from the first row."""
    first = df.groupBy(*keys).agg(F.min(t).alias("_t0"))
    bucket = F.floor((F.col(t) - F.col("_t0")) / window).alias("bucket")
    return df.join(first, list(keys)).groupBy(*keys, bucket).agg(*(F.avg(c).alias(c) for c in (t, *columns)))


def block_average(df: DataFrame, keys: Sequence[str], t: str, columns: Sequence[str], seconds: float, idx: str = "idx") -> DataFrame:
    """C20: means of blocks of int(seconds * rate) rows, rate taken from a series' length in time; only whole blocks."""
    span = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(t).alias("_b"), F.min(t).alias("_a"))
    size = F.greatest(F.lit(1), F.floor(seconds * F.col("_n") / (F.col("_b") - F.col("_a"))).cast("long"))
    rows = df.join(span.where("_b > _a").select(*keys, "_n", size.alias("_s")), list(keys))
    rows = rows.withColumn("block", F.floor(F.col(idx) / F.col("_s"))).where((F.col("block") + 1) * F.col("_s") <= F.col("_n"))
    return rows.groupBy(*keys, "block").agg(F.min(t).alias(t), *(F.avg(c).alias(c) for c in columns))


def segment(df: DataFrame, keys: Sequence[str], length: int, label: str, x: str = "x", idx: str = "idx") -> DataFrame:
    """Non-overlapping segments with their last label; a series shorter than one is padded with zeros in front."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = df.join(n, list(keys)).withColumn("segment", F.floor(F.col(idx) / length)).where(((F.col("segment") + 1) * length <= F.col("_n")) | (F.col("_n") < length))
    values = F.transform(F.sort_array(F.collect_list(F.struct(idx, x))), lambda s: s[x])
    got = rows.groupBy(*keys, "segment").agg(values.alias("_v"), F.max_by(label, idx).alias("label"))
    pad = F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(length) - F.size("_v")))
    return got.select(*keys, "segment", F.concat(pad, "_v").alias("values"), "label")


def session_timeline(df: DataFrame, keys: Sequence[str], t: str, positive: Column, bins: int = 20) -> tuple[DataFrame, DataFrame]:
    """Per series counts, ratio, duration, first and last positive as % of the session; and the positive rate by bin."""
    rows = df.withColumn("_y", positive.cast("int"))
    span = rows.groupBy(*keys).agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.count("*").alias("n"), F.sum("_y").alias("positives"), F.min(F.when(F.col("_y") == 1, F.col(t))).alias("_a"), F.max(F.when(F.col("_y") == 1, F.col(t))).alias("_b"))
    length = F.nullif(F.col("t1") - F.col("t0"), F.lit(0.0))
    summary = span.select(*keys, "n", "positives", (F.col("positives") / F.col("n")).alias("ratio"), (F.col("t1") - F.col("t0")).alias("duration"), (100 * (F.col("_a") - F.col("t0")) / length).alias("first_pct"), (100 * (F.col("_b") - F.col("t0")) / length).alias("last_pct"))
    place = F.least(F.floor((F.col(t) - F.col("t0")) / length * bins), F.lit(bins - 1))
    binned = rows.join(span.select(*keys, "t0", "t1"), list(keys)).groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"), F.avg("_y").alias("rate"))
    return summary, binned
