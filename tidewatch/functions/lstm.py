"""NumPy evaluation of the three-headed sequence network, one batch at a time.

Plain helpers for the scoring UDF: every array has the batch as its first axis.
"""

from __future__ import annotations

import numpy as np

NORM_EPS = 1e-5


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def run_layer(w: dict, layer: int, x: np.ndarray, h: np.ndarray, c: np.ndarray):
    """Outputs per time step, the last (h, c) and what the backward pass needs."""
    w_in, w_rec = w[f"lstm.weight_ih_l{layer}"], w[f"lstm.weight_hh_l{layer}"]
    drive = x @ w_in.T + (w[f"lstm.bias_ih_l{layer}"] + w[f"lstm.bias_hh_l{layer}"])
    outputs, tape = [], []
    for t in range(x.shape[1]):
        gi, gf, gg, go = np.split(drive[:, t] + h @ w_rec.T, 4, axis=1)
        i, f, g, o = _logistic(gi), _logistic(gf), np.tanh(gg), _logistic(go)
        before, c = c, f * c + i * g
        squashed = np.tanh(c)
        h = o * squashed
        outputs.append(h)
        tape.append((i, f, g, o, before, squashed))
    return np.stack(outputs, axis=1), h, c, tape


def layer_input_gradient(w: dict, layer: int, grad_out: np.ndarray, tape: list) -> np.ndarray:
    """Gradient with respect to a layer's input, given that of its outputs."""
    w_in, w_rec = w[f"lstm.weight_ih_l{layer}"], w[f"lstm.weight_hh_l{layer}"]
    grad_h = np.zeros_like(grad_out[:, 0])
    grad_c = np.zeros_like(grad_h)
    grads = [None] * len(tape)
    for t in reversed(range(len(tape))):
        i, f, g, o, before, squashed = tape[t]
        total = grad_out[:, t] + grad_h
        grad_c = grad_c + total * o * (1 - squashed**2)
        gates = np.concatenate(
            [
                grad_c * g * i * (1 - i),
                grad_c * before * f * (1 - f),
                grad_c * i * (1 - g**2),
                total * squashed * o * (1 - o),
            ],
            axis=1,
        )
        grads[t] = gates @ w_in
        grad_h = gates @ w_rec
        grad_c = grad_c * f
    return np.stack(grads, axis=1)


def _normalise(w: dict, h: np.ndarray):
    spread = np.sqrt(h.var(axis=1, keepdims=True) + NORM_EPS)
    unit = (h - h.mean(axis=1, keepdims=True)) / spread
    return unit * w["ln.weight"] + w["ln.bias"], unit, spread


def _head(w: dict, name: str, x: np.ndarray):
    hidden = x @ w[f"{name}.0.weight"].T + w[f"{name}.0.bias"]
    return np.maximum(hidden, 0) @ w[f"{name}.3.weight"].T + w[f"{name}.3.bias"], hidden


def forward(w: dict, layers: int, x: np.ndarray, memory: list | None = None) -> dict:
    """One pass over sequences ``x`` (batch, time, dim), from ``memory`` [(h, c) per layer]."""
    size = w["ln.weight"].shape[0]
    zero = np.zeros((x.shape[0], size), dtype=x.dtype)
    memory = memory or [(zero, zero)] * layers
    after, tapes, signal = [], [], x
    for layer in range(layers):
        signal, h, c, tape = run_layer(w, layer, signal, *memory[layer])
        after.append((h, c))
        tapes.append(tape)
    normed, unit, spread = _normalise(w, signal[:, -1])
    logit, hidden = _head(w, "attack_head", normed)
    return {
        "state": _head(w, "state_head", normed)[0],
        "logit": logit[:, 0],
        "classes": _head(w, "mitre_head", normed)[0],
        "memory": after,
        "tapes": tapes,
        "unit": unit,
        "spread": spread,
        "attack_hidden": hidden,
    }


def logit_gradient(w: dict, layers: int, run: dict, steps: int) -> np.ndarray:
    """Gradient of the attack logit with respect to the input sequence."""
    active = (run["attack_hidden"] > 0) * w["attack_head.3.weight"][0]
    grad = (active @ w["attack_head.0.weight"]) * w["ln.weight"]
    unit = run["unit"]
    centred = grad - grad.mean(axis=1, keepdims=True)
    grad = (centred - unit * (grad * unit).mean(axis=1, keepdims=True)) / run["spread"]
    flowing = np.zeros((grad.shape[0], steps, grad.shape[1]), dtype=grad.dtype)
    flowing[:, -1] = grad
    for layer in reversed(range(layers)):
        flowing = layer_input_gradient(w, layer, flowing, run["tapes"][layer])
    return flowing


def score_batch(w: dict, layers: int, k_steps: int, x: np.ndarray):
    """(next state, logits per step, class logits per step, importance per dimension).

    Step 1 is the sequence's own output; each later step feeds the predicted state back as
    a sequence of length 1 with the memory carried on.
    """
    run = forward(w, layers, x)
    gradient = logit_gradient(w, layers, run, x.shape[1])
    importance = np.abs(gradient * x).mean(axis=1)
    logits, classes, step = [run["logit"]], [run["classes"]], run
    for _ in range(1, k_steps):
        step = forward(w, layers, step["state"][:, None, :], step["memory"])
        logits.append(step["logit"])
        classes.append(step["classes"])
    return run["state"], np.stack(logits, 1), np.stack(classes, 1), importance
