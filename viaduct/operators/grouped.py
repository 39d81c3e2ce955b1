"""Algorithms that are sequential within a group: Spark deals the groups (scenes, entries, conversations, all of bounded
size), and a small function works on each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def viterbi_path(evidence: np.ndarray, penalty: np.ndarray) -> list[int]:
    """The best states 0/1 for emissions -evidence/+evidence and a cost of each change; ties go to state 0."""
    n = len(evidence)
    if not n:
        return []
    score, back = np.array([-evidence[0], evidence[0]], dtype=float), np.zeros((n, 2), dtype=int)
    for i in range(1, n):
        stay, change = score, score[::-1] - penalty[i]
        back[i] = np.where(change > stay, [1, 0], [0, 1])
        score = np.maximum(stay, change) + np.array([-evidence[i], evidence[i]])
    state = int(score[1] > score[0])
    path = [state]
    for i in range(n - 1, 0, -1):
        state = int(back[i][state])
        path.append(state)
    return path[::-1]


def viterbi_turns(rows: DataFrame, group: str, order: str, evidence: str, penalty: str) -> DataFrame:
    """group, order and the smoothed speaker (0 or 1) of each turn."""
    kinds = dict(rows.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf[[group, order]].assign(speaker=viterbi_path(pdf[evidence].to_numpy(float), pdf[penalty].to_numpy(float)))

    return rows.select(group, order, evidence, penalty).groupBy(group).applyInPandas(one, f"{group} {kinds[group]}, {order} {kinds[order]}, speaker int")


def activity(active: np.ndarray, span: int, share: float, miss: int = 5) -> list[tuple[int, int]]:
    """Windows [start, start + span) whose active share reaches share: a hit goes on after it, a miss by miss frames."""
    total, out, at = np.append(0, np.cumsum(active)), [], 0
    while at + span <= len(active):
        if (total[at + span] - total[at]) / span >= share:
            out.append((at, at + span))
            at += span
        else:
            at += miss
    return out


def activity_windows(rows: DataFrame, entry: str, order: list[str], active: str, span: int, share: float) -> DataFrame:
    kinds = dict(rows.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        found = activity(pdf[active].to_numpy(float), span, share)
        return pd.DataFrame({entry: [pdf[entry].iloc[0]] * len(found), "start": [a for a, _ in found], "end": [b for _, b in found]})

    return rows.select(entry, *order, active).groupBy(entry).applyInPandas(one, f"{entry} {kinds[entry]}, start long, end long")


def similarity_fit(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation and shift that take points a to b with least squares (Umeyama, 1991)."""
    ma, mb = a.mean(axis=0), b.mean(axis=0)
    u, s, vt = np.linalg.svd((b - mb).T @ (a - ma) / len(a))
    sign = np.diag([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    rotation = u @ sign @ vt
    spread = ((a - ma) ** 2).sum() / len(a)
    scale = float((s * np.diag(sign)).sum() / spread) if spread > 0 else 1.0
    return scale, rotation, mb - scale * rotation @ ma


def similarity_fits(rows: DataFrame, group: str, left: str, right: str) -> DataFrame:
    """group, scale, rotation (9), shift (3) and the root mean square of what remains."""
    kinds = dict(rows.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = np.stack(pdf[left]).astype(float), np.stack(pdf[right]).astype(float)
        scale, rotation, shift = similarity_fit(a, b)
        rest = b - (scale * a @ rotation.T + shift)
        return pd.DataFrame([{group: pdf[group].iloc[0], "scale": scale, "rotation": rotation.ravel().tolist(), "shift": shift.tolist(), "rms": float(np.sqrt((rest**2).sum(axis=1).mean()))}])

    return rows.select(group, left, right).groupBy(group).applyInPandas(one, f"{group} {kinds[group]}, scale double, rotation array<double>, shift array<double>, rms double")
