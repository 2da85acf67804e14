"""Settings of the two learned operators, compared by cross-validation inside folds 1 to 4.

``python -m layerkv.llm.tuning FOLDER`` prints, for the tables in FOLDER and each of the settings below, the
accuracy over folds 1 to 4 (each scored by a model of the other three) and the shares of either label
that are told right. The held-out fold is never read. The settings in use are those that were best here on sf0.1.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Sequence
from itertools import product

import pyarrow.parquet as pq

from layerkv.llm import quality_model, toxicity
from layerkv.llm.training import FOLDS

GRIDS = {
    "quality": (quality_model, 0.3, {"DICTIONARY": (65_536, 262_144), "PIECE": (256, 1024, 8192)}),
    "toxic": (toxicity, 0.5, {"LANDMARKS": (24, 32), "POWER": (2, 3), "WINDOW": (4, 12), "TOP": (1, 3), "PENALTY": (1e-3, 3e-4)}),
}


def cross_validated(rows: Sequence[tuple], fit: Callable, scores: Callable, threshold: float) -> tuple[float, float, float]:
    """Accuracy, and shares of label 0 and 1 told right, over (id, text, label) of folds 1 to 4."""
    folds = [(zlib.crc32(str(i).encode()) % FOLDS, t, y) for i, t, y in rows]
    right, all_ = [0, 0], [0, 0]
    for held in range(1, FOLDS):
        train = [(t, y) for f, t, y in folds if f not in (0, held)]
        model = fit(train, (sum(1 - y for _, y in train), sum(y for _, y in train)))
        test = [(t, y) for f, t, y in folds if f == held]
        for (_, y), score in zip(test, scores(model, [t for t, _ in test]), strict=True):
            all_[y] += 1
            right[y] += (score >= threshold) == bool(y)
    return sum(right) / max(1, sum(all_)), right[0] / max(1, all_[0]), right[1] / max(1, all_[1])


def scores_of(module, model, texts: list[str]) -> list[float]:
    scorer = module.Scorer(model)
    return list(scorer.scores(texts)) if module is toxicity else [scorer.score(t.encode()) for t in texts]


def main(folder: str) -> None:
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    labels = pq.read_table(f"{folder}/labels.parquet").to_pylist()
    for label, (module, threshold, grid) in GRIDS.items():
        rows = [(r["doc_id"], texts[r["doc_id"]], r[label]) for r in labels]
        for values in product(*grid.values()):
            for name, value in zip(grid, values, strict=True):
                setattr(module, name, value)
            parts = cross_validated(rows, module.fit, lambda model, t, module=module: scores_of(module, model, t), threshold)
            print(label, dict(zip(grid, values, strict=True)), *(f"{p:.4f}" for p in parts), flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
