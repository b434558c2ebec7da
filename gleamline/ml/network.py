"""One-hidden-layer regression network, fitted by full-batch L-BFGS.

Every step is one pass of the rows, packed and written once: tasks return the loss
and the gradient of the weights their rows touch, which are added up; only the weights travel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleamline.session import scratch

ALPHA = 1e-4
TOLERANCE = 1e-5  # of the loss, whose target is standardised
PATIENCE = 5
MEMORY = 10
# Rows of partial gradients the driver adds up itself; more are first added by tasks.
DIRECT_ROWS = 4096
# Rows whose hidden units are worked out at once.
STEP_ROWS = 2048
BLOCKS = "n int, num binary, slots binary, y binary"
GRADIENT = "at int, loss double, gradient array<double>"


def _layers():
    """Forward pass on numbers and slots, shipped by value."""

    def unpack(w, numbers, bases, hidden):
        width = numbers + sum(bases)
        cut = width * hidden
        return (
            w[:cut].reshape(width, hidden), w[cut : cut + hidden],
            w[cut + hidden : cut + 2 * hidden], w[cut + 2 * hidden],
        )

    def inputs(b, numbers, bases):
        num = np.stack(b["num"].to_numpy()) if numbers else np.zeros((len(b), 0))
        slots = np.stack(b["slots"].to_numpy()) if len(bases) else np.zeros((len(b), 0), int)
        return num, levels_of(slots, numbers, bases)

    def levels_of(slots, numbers, bases):
        starts = numbers + np.concatenate([[0], np.cumsum(bases)])[:-1] if len(bases) else []
        return [(slots[:, c] >= 0, int(s) + slots[:, c]) for c, s in enumerate(starts)]

    def forward(num, levels, first, bias, second, last):
        z = num @ first[: num.shape[1]]
        z += bias
        for seen, at in levels:
            if seen.all():
                z += first[at]
            else:
                z[seen] += first[at[seen]]
        h = np.maximum(z, 0.0, out=z)
        return h, h @ second + last

    return unpack, inputs, levels_of, forward


def fit(train: DataFrame, space, hidden: int, max_iter: int, seed: int) -> dict:
    numbers, bases = len(space.numbers), [space.sizes[n] for n in space.texts]
    width = numbers + sum(bases)
    rng = np.random.default_rng(seed)
    bound = np.sqrt(6.0 / (width + hidden))
    first = rng.uniform(-bound, bound, width * hidden)
    second = rng.uniform(-np.sqrt(6.0 / (hidden + 1)), np.sqrt(6.0 / (hidden + 1)), hidden)
    w = np.concatenate([first, np.zeros(hidden), second, [0.0]])
    row = train.agg(F.avg("label"), F.stddev_pop("label"), F.count("label")).first()
    mean, spread, rows = float(row[0]), float(row[1]) or 1.0, row[2]
    data = train.select("num", "slots", ((F.col("label") - mean) / spread).alias("y"))
    with scratch(_blocks(data, numbers, bases)) as blocks:
        w = _minimise(lambda v: _descent(blocks, v, numbers, bases, hidden, rows), w, max_iter)
    return {
        "weights": w.tolist(), "numbers": numbers, "bases": bases, "hidden": hidden,
        "mean": mean, "spread": spread,
    }


def _blocks(data, numbers, bases):
    """Rows as matrices' bytes: a step reads them again without taking rows apart."""

    def pack(batches):
        for b in batches:
            if len(b):
                num = np.stack(b["num"].to_numpy()) if numbers else np.zeros((len(b), 0))
                slots = np.stack(b["slots"].to_numpy()) if len(bases) else np.zeros((len(b), 0), int)
                parts = num.astype(float).tobytes(), slots.astype(np.int32).tobytes(), b["y"].to_numpy(float).tobytes()
                yield pd.DataFrame([(len(b), *parts)], columns=["n", "num", "slots", "y"])

    return data.mapInPandas(pack, BLOCKS)


def _loss(data, w, numbers, bases, hidden, rows):
    """Half mean squared error of ``num``, ``slots`` and ``y`` with an L2 penalty, and its gradient."""
    return _descent(_blocks(data, numbers, bases), w, numbers, bases, hidden, rows)


def _descent(blocks, w, numbers, bases, hidden, rows):
    """The loss and gradient over packed rows."""
    unpack, _, levels_of, forward = _layers()
    shared = blocks.sparkSession.sparkContext.broadcast(w)
    width = numbers + sum(bases)

    def partial(batches):
        first, bias, second, last = unpack(shared.value, numbers, bases, hidden)
        loss, g_numbers, g_bias = 0.0, np.zeros((numbers, hidden)), np.zeros_like(bias)
        g_second, g_last, g_levels = np.zeros_like(second), 0.0, {}
        for batch in batches:
            for n, *parts in batch[["n", "num", "slots", "y"]].itertuples(index=False):
                all_num, all_slots = np.frombuffer(parts[0]).reshape(n, numbers), np.frombuffer(parts[1], np.int32).reshape(n, len(bases))
                all_y = np.frombuffer(parts[2])
                for at in range(0, n, STEP_ROWS):  # so many stay in a core's own memory
                    num, y = all_num[at : at + STEP_ROWS], all_y[at : at + STEP_ROWS]
                    levels = levels_of(all_slots[at : at + STEP_ROWS], numbers, bases)
                    h, out = forward(num, levels, first, bias, second, last)
                    error = out - y
                    loss += 0.5 * float(error @ error)
                    g_second += error @ h
                    g_last += float(error.sum())
                    back = error[:, None] * (h > 0)  # times second, which is the same for all rows
                    g_bias += back.sum(0) * second
                    g_numbers += (num.T @ back) * second
                    for seen, level in levels:
                        held, sums = add_by_level(level[seen], back[seen] if not seen.all() else back)
                        for j, total in zip(held.tolist(), sums):
                            g_levels[j] = g_levels[j] + total if j in g_levels else total
        yield pd.DataFrame({
            "at": [-1, *range(numbers), *g_levels],
            "loss": [loss] + [0.0] * (numbers + len(g_levels)),
            "gradient": [np.concatenate([g_bias, g_second, [g_last]]), *g_numbers, *(g * second for g in g_levels.values())],
        })

    def add_by_level(level, back):
        """The levels there, and the sum of each one's rows."""
        held, place = np.unique(level, return_inverse=True)
        if len(held) <= 64:
            return held, (np.arange(len(held))[:, None] == place[None, :]).astype(float) @ back
        order = np.argsort(place, kind="stable")
        starts = np.searchsorted(place[order], np.arange(len(held)))
        return held, np.add.reduceat(back[order], starts, axis=0)

    def add(parts):
        return pd.DataFrame({
            "at": [parts["at"].iloc[0]], "loss": [parts["loss"].sum()],
            "gradient": [np.sum(np.stack(parts["gradient"].to_numpy()), axis=0)],
        })

    parts = blocks.mapInPandas(partial, GRADIENT)
    # Few small partial gradients are added up here; more are first added where they are, a row of weights at a time.
    if blocks.rdd.getNumPartitions() * (width + 1) > DIRECT_ROWS:
        parts = parts.groupBy("at").applyInPandas(add, GRADIENT)
    cut = width * hidden
    loss, gradient = 0.0, np.zeros_like(w)
    for at, part, values in parts.toPandas().itertuples(index=False):
        loss += part
        where = slice(cut, None) if at < 0 else slice(at * hidden, (at + 1) * hidden)
        gradient[where] += values
    shared.destroy()
    penalised = w.copy()
    penalised[cut : cut + hidden] = 0.0
    penalised[-1] = 0.0
    loss = (loss + 0.5 * ALPHA * float(penalised @ penalised)) / rows
    return loss, (gradient + ALPHA * penalised) / rows


def _minimise(objective, w, max_iter):
    """L-BFGS with backtracking; stops when steps stop paying."""
    loss, gradient = objective(w)
    pairs, idle = [], 0
    for _ in range(max_iter):
        direction = -_two_loop(gradient, pairs)
        slope = float(direction @ gradient)
        if slope >= 0:
            direction, slope, pairs = -gradient, -float(gradient @ gradient), []
        step = 1.0 if pairs else min(1.0, 1.0 / (np.abs(gradient).sum() + 1e-12))
        while True:
            moved = w + step * direction
            new_loss, new_gradient = objective(moved)
            if new_loss <= loss + 1e-4 * step * slope:
                break
            step *= 0.5
            if step < 1e-8:
                return w
        change, turn = moved - w, new_gradient - gradient
        if float(change @ turn) > 1e-12:
            pairs = [*pairs, (change, turn)][-MEMORY:]
        idle = idle + 1 if loss - new_loss < TOLERANCE else 0
        w, loss, gradient = moved, new_loss, new_gradient
        if idle >= PATIENCE or np.abs(gradient).max() < 1e-7:
            break
    return w


def _two_loop(gradient, pairs):
    q, kept = gradient.copy(), []
    for s, y in reversed(pairs):
        a = float(s @ q) / float(y @ s)
        q -= a * y
        kept.append(a)
    if pairs:
        s, y = pairs[-1]
        q *= float(s @ y) / float(y @ y)
    for (s, y), a in zip(pairs, reversed(kept)):
        q += s * (a - float(y @ q) / float(y @ s))
    return q


def predict(df: DataFrame, state: dict) -> DataFrame:
    unpack, inputs, _, forward = _layers()
    w, numbers, bases = np.array(state["weights"]), state["numbers"], state["bases"]
    hidden, mean, spread = state["hidden"], state["mean"], state["spread"]
    shared = df.sparkSession.sparkContext.broadcast(w)

    def apply(batches):
        layers = unpack(shared.value, numbers, bases, hidden)
        for b in batches:
            if len(b):
                out = forward(*inputs(b, numbers, bases), *layers)[1] * spread + mean
                yield b[["id"]].assign(prediction=out)

    found = df.select("id", "num", "slots").mapInPandas(apply, "id bigint, prediction double")
    return df.join(found, "id")
