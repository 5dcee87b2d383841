"""Forward passes of the networks on batches of rows.

These helpers see one Arrow batch at a time inside a Spark task; Spark reads,
partitions and schedules the rows.  A network is a list of stages, so its layer
sizes are data.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

KERNEL = 3
SLICE_ROWS = 128
#: Rows of a flat network at a time: products of fewer spend more of their time laying out the weights.
FLAT_ROWS = 1024


@dataclass(frozen=True)
class Net:
    """``stages`` describe the layer stack; a flat network has none.

    A stage is ("conv", channels, stride), ("act",), ("pool", width) or
    ("global_max",).
    """

    stages: tuple[tuple, ...]
    dense: tuple[int, ...]
    activation: str
    channels: int = 6
    scalars: int = 4
    output: str = "sigmoid"


def convs(activated: bool, *plan: tuple[int, int]) -> tuple[tuple, ...]:
    stages = []
    for width, stride in plan:
        stages.append(("conv", width, stride))
        if activated:
            stages.append(("act",))
    return tuple(stages)


# Layer sizes of the published networks.
CONV_NET = Net(
    stages=convs(True, (32, 1), (64, 1), (64, 1), (64, 2), (64, 2), (64, 2)),
    dense=(512, 512, 256, 128),
    activation="elu",
)
CONV_NET_LINEAR = replace(CONV_NET, output="linear")
MAX_POOL_NET = Net(
    stages=(
        *convs(True, (32, 1), (64, 1), (128, 1), (256, 1), (256, 1), (256, 1)),
        ("global_max",),
    ),
    dense=(512, 512, 256, 128),
    activation="elu",
)
INITIAL_NET = Net(
    stages=(
        *convs(False, (32, 1), (32, 1)),
        ("pool", 2),
        *convs(False, (64, 1), (128, 1), (128, 1)),
        ("pool", 5),
        *convs(False, (256, 1), (256, 1)),
        ("global_max",),
    ),
    dense=(512,) * 10 + (256, 128),
    activation="relu",
    scalars=3,
)
FLAT_NET = Net(stages=(), dense=(1024, 1024, 1024, 512, 256, 128), activation="relu")


def parameter_shapes(net: Net, layers: int) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Weight and bias shapes in forward order."""
    shapes = []
    channels, length = net.channels, layers
    for stage in net.stages:
        if stage[0] == "conv":
            _, width, stride = stage
            shapes.append(((width, channels, KERNEL), (width,)))
            channels, length = width, -(-length // stride)
        elif stage[0] == "pool":
            length //= stage[1]
        elif stage[0] == "global_max":
            length = 1
    flat = channels * length + net.scalars if net.stages else net.channels * layers + 3
    for width in (*net.dense, 1):
        shapes.append(((width, flat), (width,)))
        flat = width
    return shapes


def waves(net: Net, layers: int, dtype: str = "float32") -> list[tuple[np.ndarray, np.ndarray]]:
    """Reproducible stand-in weights from a closed formula (no weights are published).

    Parameter p at flat position i is sin(i + p + 1) / sqrt(inputs); biases are a
    tenth of that.
    """
    made = []
    for p, (weight, bias) in enumerate(parameter_shapes(net, layers)):
        inputs = int(np.prod(weight[1:]))
        w = np.sin(np.arange(np.prod(weight), dtype="float64") + p + 1) / np.sqrt(inputs)
        b = np.sin(np.arange(bias[0], dtype="float64") + p + 1) / 10
        made.append((w.reshape(weight).astype(dtype), b.astype(dtype)))
    return made


def parameters_to_rows(parameters) -> list[tuple[int, str, int, float]]:
    """(layer, kind, position, value) in forward order, positions row-major."""
    return [
        (layer, kind, at, float(value))
        for layer, pair in enumerate(parameters)
        for kind, values in zip(("weight", "bias"), pair)
        for at, value in enumerate(np.ravel(values))
    ]


def parameters_from_rows(net: Net, layers: int, rows, dtype: str = "float32") -> list[tuple[np.ndarray, np.ndarray]]:
    """Parameters of ``net`` from (layer, kind, position, value); each number exactly once."""
    shapes = parameter_shapes(net, layers)
    made = [(np.full(w, np.nan), np.full(b, np.nan)) for w, b in shapes]
    seen = 0
    for layer, kind, at, value in rows:
        if not 0 <= layer < len(made) or kind not in ("weight", "bias"):
            raise ValueError(f"the network has no {kind} in layer {layer}")
        flat = made[layer][kind == "bias"].reshape(-1)
        if not 0 <= at < len(flat) or not np.isnan(flat[at]):
            raise ValueError(f"{kind} {at} of layer {layer} does not fit or occurs twice")
        flat[at], seen = value, seen + 1
    if seen != sum(w.size + b.size for w, b in made):
        raise ValueError(f"{seen} numbers do not fill the network")
    return [(w.astype(dtype), b.astype(dtype)) for w, b in made]


def check_parameters(net: Net, layers: int, parameters) -> None:
    found = [(np.shape(w), np.shape(b)) for w, b in parameters]
    if found != parameter_shapes(net, layers):
        raise ValueError(f"parameters do not fit the network: {found}")


def _activate(x: np.ndarray, kind: str) -> np.ndarray:
    """ReLU or ELU in place; exp(x) - 1 never falls below x, so a maximum selects the branch."""
    if kind == "relu":
        return np.maximum(x, 0, out=x)
    below = np.minimum(x, 0)
    np.exp(below, out=below)
    below -= 1
    return np.maximum(x, below, out=below)


def _extended(x: np.ndarray, rest: np.ndarray, before: int, upto: int) -> np.ndarray:
    """``before`` zeros, the positions of ``x``, then those of ``rest``, then zeros: up to position ``upto``."""
    rows, reach, channels = x.shape
    out = np.zeros((rows, before + upto, channels), x.dtype)
    head, tail = min(reach, upto), min(len(rest), upto)
    out[:, before : before + head] = x[:, :head]
    out[:, before + head : before + tail] = rest[head:tail]
    return out


def _convolve(x: np.ndarray, rest: np.ndarray, taps: np.ndarray, bias: np.ndarray, stride: int) -> np.ndarray:
    """Zero-padded convolution of (rows, reach, channels): one matrix product per tap.

    Position q sees q * stride - 1 and the two after it, so those beyond
    reach // stride see nothing but ``rest``.
    """
    rows, reach, channels = x.shape
    steps = min(-(-len(rest) // stride), reach // stride + 1)
    span = (steps - 1) * stride + 1
    padded = _extended(x, rest, 1, span + KERNEL - 2)
    out = np.broadcast_to(bias, (rows * steps, len(bias))).copy()
    for at, tap in enumerate(taps):
        out += padded[:, at : at + span : stride].reshape(rows * steps, channels) @ tap
    return out.reshape(rows, steps, -1)


def _pool(x: np.ndarray, rest: np.ndarray, width: int) -> np.ndarray:
    rows, reach, channels = x.shape
    steps = min(len(rest) // width, -(-reach // width))
    if reach < steps * width:
        x = _extended(x, rest, 0, steps * width)
    return x[:, : steps * width].reshape(rows, steps, width, channels).max(axis=2)


def _global_max(x: np.ndarray, rest: np.ndarray) -> np.ndarray:
    top = x.max(axis=1, keepdims=True)
    return np.maximum(top, rest[x.shape[1] :].max(axis=0)) if x.shape[1] < len(rest) else top


def _stage(net: Net, stage: tuple, queue, x: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """One stage over the first positions of some profiles; behind them they are as in ``rest``."""
    if stage[0] == "conv":
        return _convolve(x, rest, *next(queue), stage[2])
    if stage[0] == "act":
        return _activate(x, net.activation)
    return _pool(x, rest, stage[1]) if stage[0] == "pool" else _global_max(x, rest)


def _bare(net: Net, arranged, layers: int, dtype) -> list[np.ndarray]:
    """What each stage takes in for a profile without layers, and what the last one gives."""
    queue, states = iter(arranged), [np.zeros((layers, net.channels), dtype)]
    for stage in net.stages:
        states.append(_stage(net, stage, queue, states[-1][None].copy(), states[-1])[0])
    return states


def _arranged(parameters) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights laid out for row-major products: taps x inputs x outputs, or inputs x outputs."""
    return [(np.ascontiguousarray(np.transpose(w)), b) for w, b in parameters]


def _depths(snow: np.ndarray) -> np.ndarray:
    """Per row, the layers up to the last that differs from an absent one in any channel; at least one."""
    there = (snow != 0).any(axis=1)
    return np.where(there.any(axis=1), there.shape[1] - there[:, ::-1].argmax(axis=1), 1)


def forward(net: Net, dense, x: np.ndarray) -> np.ndarray:
    """Predictions from the inputs of the dense layers; dropout is off at inference."""
    for weight, bias in dense[:-1]:
        x = x @ weight
        x += bias
        x = _activate(x, net.activation)
    weight, bias = dense[-1]
    x = (x @ weight + bias)[:, 0]
    return 1 / (1 + np.exp(-x)) if net.output == "sigmoid" else x


def _predict_flat(net: Net, arranged, x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The dense layers slice by slice; the first one skips inputs that are zero in a whole slice.

    Layers that no profile of a slice has are such inputs.  One with a weight
    that is not finite is never skipped, as zero times that is no zero.
    """
    (weight, bias), rest = arranged[0], arranged[1:]
    needed = ~np.isfinite(weight).all(axis=1)
    for start in range(0, len(x), FLAT_ROWS):
        part = x[start : start + FLAT_ROWS]
        met = np.flatnonzero(needed | (part != 0).any(axis=0))
        out[start : start + FLAT_ROWS] = forward(net, [(weight[met], bias), *rest], part[:, met])
    return out


def predict(net: Net, parameters, snow: np.ndarray | None, scalars: np.ndarray) -> np.ndarray:
    """Run the network slice by slice so the intermediate layers stay small.

    Absent layers at the end of a profile are zeros, and behind them every stage
    gives what it gives for a profile without layers.  So rows are taken by
    depth, and a stage computes only the positions that the slice's deepest
    profile can reach; the rest is computed once.
    """
    arranged = _arranged(parameters)
    out = np.empty(len(scalars), dtype=scalars.dtype)
    if snow is None:
        return _predict_flat(net, arranged, scalars, out)
    bare = _bare(net, arranged, snow.shape[2], snow.dtype)
    convolved = sum(stage[0] == "conv" for stage in net.stages)
    depths = _depths(snow)
    order = np.argsort(depths, kind="stable")
    for start in range(0, len(scalars), SLICE_ROWS):
        part, queue = order[start : start + SLICE_ROWS], iter(arranged)
        x = snow[part, :, : depths[part[-1]]].transpose(0, 2, 1)
        for stage, rest in zip(net.stages, bare):
            x = _stage(net, stage, queue, x, rest)
        x = _extended(x, bare[-1], 0, len(bare[-1]))
        x = np.concatenate([x.transpose(0, 2, 1).reshape(len(x), -1), scalars[part]], axis=1)
        out[part] = forward(net, arranged[convolved:], x)
    return out
