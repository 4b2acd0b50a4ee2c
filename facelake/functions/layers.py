"""Embedders by name: functions from a batch of images (n, c, h, w) to vectors (n, d)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark import SparkContext
from pyspark.accumulators import Accumulator, AccumulatorParam

Embedder = Callable[[np.ndarray], np.ndarray]
Maker = Callable[[str], Embedder]

#: What this process has built, by name, weights and the registry's generation.
_BUILT: dict[tuple[str, str, int], Embedder] = {}


class _Union(AccumulatorParam):
    """Sets that tasks add to."""

    def zero(self, value):
        return set()

    def addInPlace(self, value1, value2):
        value1 |= value2
        return value1


def loaded(name: str, weights: str, make: Maker, generation: int = 0) -> Embedder:
    """The embedder, built once in each process; those of earlier generations are let go."""
    if (name, weights, generation) not in _BUILT:
        for old in [k for k in _BUILT if k[2] < generation]:
            del _BUILT[old]
        _BUILT[name, weights, generation] = make(weights)
    return _BUILT[name, weights, generation]


class Registry:
    """Makers of embedders by name, and which have been built where the work is done.

    Models are built in the workers; each reports what it has built through an accumulator, so that the driver
    knows after a job. `clear` forgets that, and makes the next job build anew.
    """

    def __init__(self):
        self._makers: dict[str, Maker] = {}
        self._reports: dict[str, Accumulator] = {}
        self._generation = 0

    def register(self, name: str, make: Maker) -> None:
        if not callable(make):
            raise TypeError("an embedder is made by a function of the weights' path")
        self._makers[name] = make

    def names(self) -> list[str]:
        return sorted(self._makers)

    def maker(self, name: str) -> Maker:
        if name not in self._makers:
            raise KeyError(f"unknown model {name!r}; known are {', '.join(self.names())}")
        return self._makers[name]

    def get(self, name: str, weights: str = "") -> Embedder:
        return loaded(name, weights, self.maker(name), self._generation)

    def _report(self, context: SparkContext) -> Accumulator:
        if context.applicationId not in self._reports:
            self._reports[context.applicationId] = context.accumulator(set(), _Union())
        return self._reports[context.applicationId]

    def builder(self, context: SparkContext, name: str, weights: str = "") -> Callable[[], Embedder]:
        """A function for the tasks that gives the embedder, built once in each process, and reports it.

        The maker is sent along, since a worker imports a registry of its own.
        """
        make, report, generation = self.maker(name), self._report(context), self._generation

        def build() -> Embedder:
            network = loaded(name, weights, make, generation)
            report.add({(name, weights)})
            return network

        return build

    def is_loaded(self, name: str, weights: str = "") -> bool:
        """Whether this process or a worker of a finished job has built the embedder."""
        return (name, weights, self._generation) in _BUILT or any((name, weights) in r.value for r in self._reports.values())

    def clear(self) -> None:
        self._generation += 1
        _BUILT.clear()
        for report in self._reports.values():
            report.value = set()


REGISTRY = Registry()


def seeded_projection(seed: str) -> Embedder:
    """A fixed projection of 8 x 8 block means to 512 values, for tests and dry runs: the weight of block i in value j is
    the sine of (i + 1) (j + 1 + seed)."""
    at = int(seed or 0)
    matrix = np.sin(np.outer(np.arange(1, 3 * 14 * 14 + 1), np.arange(1, 513) + at)) / 24

    def embed(x: np.ndarray) -> np.ndarray:
        n, c, h, w = x.shape
        return x.astype(np.float64).reshape(n, c, 14, h // 14, 14, w // 14).mean(axis=(3, 5)).reshape(n, -1) @ matrix

    return embed


def pixels(_: str) -> Embedder:
    """The image's own values, for checks of what comes before a network."""
    return lambda x: x.reshape(len(x), -1)


def linear_head(file: str) -> Embedder:
    """One linear layer over the image's values, with shipped weights `weight` (d, values) and `bias` (d)."""
    from facelake.sources.checkpoints import load_weights

    held = load_weights(file)
    weight, bias = held["weight"].astype(np.float64), held["bias"].astype(np.float64)
    return lambda x: x.reshape(len(x), -1).astype(np.float64) @ weight.T + bias


def onnx_model(path: str) -> Embedder:
    """A network in an ONNX file; its first input takes the batch, its first output is the embedding. A path that is no file of
    its own names one that the session has shipped."""
    import os

    import onnxruntime
    from pyspark import SparkFiles

    file = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
    run = onnxruntime.InferenceSession(file, providers=["CPUExecutionProvider"])
    name = run.get_inputs()[0].name
    return lambda x: run.run(None, {name: x.astype(np.float32)})[0]


REGISTRY.register("seeded_projection", seeded_projection)
REGISTRY.register("pixels", pixels)
REGISTRY.register("linear_head", linear_head)
REGISTRY.register("onnx", onnx_model)
#: Named networks, whose weights are ONNX files; two names may share a network.
for _name in ("mobilenetv3_large", "mobilenetv3_small", "mobilenetv3_large_iti", "cosface_resnet50"):
    REGISTRY.register(_name, onnx_model)
