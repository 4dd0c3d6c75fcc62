"""M9: fitting the dense network on Spark, with its products in numpy.

``Network`` is Spark's ``MultilayerPerceptronClassifier`` with another fit: the same
network (sigmoid layers, softmax, mean cross-entropy), starting weights, L-BFGS rule and
stopping rule, and the same kind of model.  The loss is the mean over rows (Spark's: the
mean of the means of blocks of 128 rows and of rests).  Spark's fit multiplies in the JVM in double
precision; this one packs the rows once into kept blocks and multiplies them in single
precision, as the reference's network does.  A pass is a job over the blocks: each
partition sums its loss and gradient, and these are added by a tree; sums over blocks and
the search are in double precision.  The driver holds weights and gradients only, of a
size that the layers fix.
"""
from __future__ import annotations

import numpy as np
from pyspark import StorageLevel, keyword_only
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

ROWS = 512                # rows of a block
PARTITION_ROWS = 1 << 18  # rows of a partition at most
CORRECTIONS = 10          # steps that the curvature is taken from
SUFFICIENT, CURVATURE = 1e-4, 0.9
SEARCH_STEPS = 10


def _blocks(rows):
    """(features, labels) of ``ROWS`` rows each."""
    held = []
    for label, features in rows:
        held.append((label, features))
        if len(held) == ROWS:
            yield _packed(held)
            held = []
    if held:
        yield _packed(held)


def _packed(held):
    return np.array([f for _, f in held], np.float32), np.array([y for y, _ in held], np.int32)


def _layers(weights: np.ndarray, sizes) -> list:
    """(matrix, bias) of each layer, in the order in which Spark's model keeps them."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((weights[at:at + a * b].reshape(a, b), weights[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def loss_and_gradient(blocks, weights: np.ndarray, sizes) -> np.ndarray:
    """Summed gradient over the blocks' rows, then their summed loss and their number."""
    net = _layers(weights.astype(np.float32), sizes)
    total = np.zeros(len(weights) + 2)
    grads = _layers(total[:-2], sizes)
    for x, y in blocks:
        values = [x]
        for i, (w, b) in enumerate(net):
            z = values[-1] @ w
            z += b
            if i < len(net) - 1:
                # 0.5 (1 + tanh(z / 2)) is the sigmoid, without overflow.
                z *= np.float32(0.5)
                np.tanh(z, out=z)
                z += np.float32(1)
                z *= np.float32(0.5)
            values.append(z)
        z = values.pop()
        z -= z.max(axis=1, keepdims=True)
        rows = np.arange(len(y))
        own = z[rows, y].astype(np.float64)
        np.exp(z, out=z)
        norm = z.sum(axis=1, keepdims=True)
        total[-2] += np.log(norm[:, 0].astype(np.float64)).sum() - own.sum()
        total[-1] += len(y)
        z /= norm
        z[rows, y] -= 1
        for i in range(len(net) - 1, -1, -1):
            h = values[i]
            grads[i][0][...] += h.T @ z
            grads[i][1][...] += z.sum(axis=0, dtype=np.float64)
            if i:
                z = z @ net[i][0].T
                z *= h
                z *= 1 - h
    return total


class SearchFailed(Exception):
    """No step along the direction meets the conditions."""


def _step(value, slope: float, at: float, first: float) -> float:
    """A step that meets the strong Wolfe conditions; ``value(t)`` gives (loss, slope)."""
    def enough(t, f):
        return f <= at + SUFFICIENT * t * slope

    def between(l, r):
        d = l[2] + r[2] - 3 * (l[1] - r[1]) / (l[0] - r[0])
        root = np.sqrt(d * d - l[2] * r[2])
        t = r[0] - (r[0] - l[0]) * (r[2] + root - d) / (r[2] - l[2] + 2 * root)
        low, high = l[0] + 0.1 * (r[0] - l[0]), l[0] + 0.9 * (r[0] - l[0])
        return float(min(max(t, low), high)) if np.isfinite(t) else (low + high) / 2

    def zoom(low, high):
        for _ in range(SEARCH_STEPS):
            t = between(*sorted((low, high), key=lambda p: p[0]))
            c = (t, *value(t))
            if not enough(t, c[1]) or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= CURVATURE * abs(slope):
                return t
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise SearchFailed

    low, t = (0.0, at, slope), first
    if slope > 0:
        raise SearchFailed
    for i in range(SEARCH_STEPS):
        c = (t, *value(t))
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if not enough(t, c[1]) or (c[1] >= low[1] and i):
            return zoom(low, c)
        if abs(c[2]) <= CURVATURE * abs(slope):
            return t
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise SearchFailed


def _direction(grad, steps, changes):
    """Minus the gradient by the approximate inverse curvature of the last steps."""
    d, parts = grad.copy(), []
    for s, y in zip(reversed(steps), reversed(changes)):
        a = (s @ d) / (s @ y)
        parts.append(a)
        d -= a * y
    if steps:
        d *= (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
    for s, y, a in zip(steps, changes, reversed(parts)):
        d += (a - (y @ d) / (s @ y)) * s
    return -d


def minimise(f, x: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """L-BFGS from ``x``; ``f(x)`` gives (loss, gradient).  It stops after ``max_iter`` steps,
    when ten steps have changed the loss by less than ``tol`` of the first one, when
    the gradient is as small, or when the search fails twice."""
    loss, grad = f(x)
    first, seen, steps, changes, failed = loss, [loss], [], [], False
    done = 0
    while done < max_iter and np.linalg.norm(grad) > max(tol * loss, 1e-8):
        d = _direction(grad, steps, changes)
        tried = {}

        def value(t):
            tried.clear()
            tried[t] = new = f(x + t * d)
            return new[0], float(new[1] @ d)

        try:
            t = _step(value, float(grad @ d), loss, 1.0 if done else 1.0 / np.linalg.norm(d))
            if t * np.linalg.norm(grad) < 1e-10:
                raise SearchFailed
        except SearchFailed:
            if failed:
                break
            failed, steps, changes = True, [], []
            continue
        after, new = tried[t]
        if d @ (new - grad) > 0:
            steps, changes = [*steps, t * d][-CORRECTIONS:], [*changes, new - grad][-CORRECTIONS:]
        else:
            steps, changes = [], []
        x, loss, grad, done = x + t * d, after, new, done + 1
        seen = [*seen, loss][-10:]
        if abs(loss - max(seen)) <= tol * abs(first):
            break
    return x


class Network(MultilayerPerceptronClassifier):
    """Spark's multilayer perceptron, fitted by passes over packed blocks of rows."""

    @keyword_only
    def __init__(self, *, layers=None, maxIter=100, seed=None):
        super().__init__(**self._input_kwargs)

    def _fit(self, dataset):
        sizes, spark = self.getLayers(), dataset.sparkSession
        label, features = self.getLabelCol(), self.getFeaturesCol()
        # Without steps, Spark's fit returns its starting weights, or a model of given ones.
        shell = MultilayerPerceptronClassifier(layers=sizes, maxIter=0, seed=self.getSeed(), labelCol=label, featuresCol=features,
                                               predictionCol=self.getPredictionCol(), probabilityCol=self.getProbabilityCol(),
                                               rawPredictionCol=self.getRawPredictionCol())
        one = spark.createDataFrame([(float(sizes[-1] - 1), Vectors.dense([0.0] * sizes[0]))], [label, features])
        start = self.getInitialWeights() if self.isSet(self.initialWeights) else shell.fit(one).weights
        rows = dataset.select(F.col(label).cast("int"), vector_to_array(features, "float32"))
        # As many rows in each partition, and one for each core if they hold them: a pass ends
        # with its slowest task, and every task costs a start.
        cores = spark.sparkContext.defaultParallelism
        rounds = -(-rows.count() // (cores * PARTITION_ROWS)) or 1
        blocks = rows.repartition(cores * rounds).rdd.mapPartitions(_blocks).persist(StorageLevel.MEMORY_AND_DISK)

        def pass_over(weights):
            sent = spark.sparkContext.broadcast(weights)
            total = blocks.mapPartitions(lambda part: [loss_and_gradient(part, sent.value, sizes)]).treeReduce(np.add)
            sent.destroy()
            return total[-2] / total[-1], total[:-2] / total[-1]

        try:
            weights = minimise(pass_over, start.toArray(), self.getMaxIter(), self.getTol())
        finally:
            blocks.unpersist()
        return shell.setInitialWeights(Vectors.dense(weights)).fit(one)
