"""The exponential average of each key as state of a stream."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def _order(row: tuple) -> tuple:
    return row[:-1]


class Average(StatefulProcessor):
    """Folds values as they arrive, in their order.

    The last `hold` values of a key, by order, wait for others that come late; what is older
    is folded into (ema, step). A micro-batch's rows are put in order before any is folded,
    some `chunk` of them at a time. A value that comes when a later one is folded already is
    folded then and counted in n_late. After each micro-batch a key's average is given with
    the waiting values in it.

    Rows are (group, whether there is a key, key, order..., value), and nothing but a key is null. A call of the state store costs more than folding
    a short series, so what is kept of a group, which may have many keys, is one value, read
    once and written once a micro-batch: the pickle of {key: [ema, step, n_late, order of the
    last value folded, waiting rows]}. Memory is that, `chunk` rows and an Arrow batch, whatever
    a key has.
    With ttl, groups without news for so many milliseconds are forgotten.
    """

    def __init__(self, by: str, decay: float, hold: int, ttl: int | None, chunk: int = 1 << 14):
        self.by, self.decay, self.hold, self.ttl, self.chunk = by, decay, hold, ttl, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("averages", "kept binary", self.ttl)

    def fold(self, ema: float | None, step: int, rows: list[tuple]) -> tuple[float | None, int]:
        """step: how many values there were."""
        for row in rows:
            if step:
                d = min(self.decay, (1 + step) / (10 + step))
                ema = ema * d + row[-1] * (1 - d)
            else:
                ema = row[-1]
            step += 1
        return ema, step

    def settle(self, kept: dict, arrived: dict) -> None:
        """All but the last `hold` rows of each key that had news are folded."""
        for key, new in arrived.items():
            ema, step, late, last, waiting = kept.get(key, (None, 0, 0, None, []))
            waiting = sorted(waiting + new, key=_order)
            done, waiting = waiting[: max(0, len(waiting) - self.hold)], waiting[max(0, len(waiting) - self.hold) :]
            if done:
                if last is not None and _order(done[0]) < last:
                    late += sum(_order(r) < last for r in done)
                last = _order(done[-1]) if last is None else max(last, _order(done[-1]))
                ema, step = self.fold(ema, step, done)
            kept[key] = [ema, step, late, last, waiting]

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        kept = pickle.loads(self.state.get()[0]) if self.state.exists() else {}
        arrived, n, news = {}, 0, {}
        for pdf in rows:
            there, keys, *values = (pdf[c].tolist() for c in pdf.columns[1:])
            for k, row in zip((k if t else None for t, k in zip(there, keys, strict=True)), zip(*values, strict=True), strict=True):
                arrived.setdefault(k, []).append(row)
            n += len(pdf)
            if n >= self.chunk:
                self.settle(kept, arrived)
                news, arrived, n = news | dict.fromkeys(arrived), {}, 0
        self.settle(kept, arrived)
        self.state.update((pickle.dumps(kept),))
        found = [(k, *self.fold(*kept[k][:2], kept[k][-1]), kept[k][2]) for k in news | arrived]
        yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip((self.by, "ema", "n", "n_late"), zip(*found, strict=True), strict=True)})

    def close(self) -> None:
        pass
