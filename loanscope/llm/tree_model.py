"""Tree-structured graphical model: unary features, parent-child potentials, sum-product messages.

Each node is boilerplate (0), content (1) or, if it is an element with both
below it, mixed (2).  The score of a labelling is the sum over nodes of their
features' weights for their state, and over edges of a potential of the parent's
and the child's state.  Messages go up from the leaves and down from the root,
one depth at a time for all trees together; they give exact marginals and, in
training, the exact gradient of the labelled trees' log-likelihood.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STATES = 3
NEVER = -1e4


@dataclass
class Forest:
    """Several trees' nodes: parent (-1 for a root), depth, leaf flag, and (node, feature) pairs."""

    parent: np.ndarray
    depth: np.ndarray
    leaf: np.ndarray
    node: np.ndarray
    feature: np.ndarray

    def levels(self) -> list[np.ndarray]:
        order = np.argsort(self.depth, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1) if len(order) else []


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def _unary(forest: Forest, unary: np.ndarray) -> np.ndarray:
    scores = np.stack([np.bincount(forest.node, unary[forest.feature, s], minlength=len(forest.parent)) for s in range(STATES)], axis=1)
    scores[forest.leaf, 2] = NEVER
    return scores


def infer(forest: Forest, unary: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals of each node, sum over all edges of the marginals of parent and child state)."""
    below = _unary(forest, unary)                           # own score and messages from children
    sent = np.zeros_like(below)
    levels = forest.levels()
    for nodes in reversed(levels[1:]):                      # upward
        sent[nodes] = _logsumexp(edge[None] + below[nodes][:, None, :], axis=2)
        np.add.at(below, forest.parent[nodes], sent[nodes])
    belief, pairs = below.copy(), np.zeros((STATES, STATES))
    for nodes in levels[1:]:                                # downward
        cavity = belief[forest.parent[nodes]] - sent[nodes]
        joint = edge[None] + cavity[:, :, None] + below[nodes][:, None, :]
        belief[nodes] = _logsumexp(joint, axis=1)
        joint -= _logsumexp(joint.reshape(len(nodes), -1), axis=1)[:, None, None]
        pairs += np.exp(joint).sum(axis=0)
    return np.exp(belief - _logsumexp(belief, axis=1)[:, None]) if len(belief) else belief, pairs


def train(forest: Forest, state: np.ndarray, features: int, *, rounds: int = 120, step: float = 0.2,
          ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Unary weights and edge potentials that maximise the log-likelihood of the nodes' states (Adam, exact gradient)."""
    child = np.flatnonzero(forest.parent >= 0)
    seen_pairs = np.zeros((STATES, STATES))
    np.add.at(seen_pairs, (state[forest.parent[child]], state[child]), 1)
    seen = np.zeros((features, STATES))
    np.add.at(seen, (forest.feature, state[forest.node]), 1)
    theta = np.zeros((features + STATES, STATES))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        marginals, pairs = infer(forest, theta[:features], theta[features:])
        expected = np.stack([np.bincount(forest.feature, marginals[forest.node, s], minlength=features) for s in range(STATES)], axis=1)
        grad = np.concatenate([seen - expected, seen_pairs - pairs]) / len(state) - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        theta += step * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    return theta[:features], theta[features:]
