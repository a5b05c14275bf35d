"""Two or more feeds by session: a session is issued once, in order, when all feeds have it; what is issued never changes."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

OUT = "session long, kind string, feed string, value double, archived double, n long, total double"
STATE = "next long, total double, waiting_s array<long>, waiting_f array<string>, waiting_v array<double>, done_s array<long>, done_v array<double>, blocked string"


def issue_sessions(rows: DataFrame, key: str, session: str, feed: str, value: str, feeds: list[str], first: int = 1, recall: int = 5000) -> DataFrame:
    """(key, session, kind, feed, value, archived, n, total) of a stream of ``rows`` (key, session, feed, value).

    - ``issued``: the next session has a finite value of every one of ``feeds``; ``value`` is the first feed less the others, ``n`` and
      ``total`` count and add up what the key has issued so far. Sessions are whole numbers from ``first``, without gaps.
    - ``blocked``: later sessions are there, but the next lacks ``feed``; said once. Nothing is issued until it comes.
    - ``revision``: a row of a session that is issued (one of its last ``recall``) differs from what was ``archived``; it is
      recorded and not applied. Rows that say the same again say nothing.

    Before a session is issued the last value of a feed in (session, feed, value) order of a batch counts. State holds a key's
    waiting rows and its last issued values, so a run resumed from a checkpoint goes on as an uninterrupted one would.
    Rows without a finite value, and feeds that aren't asked for, are left out.
    """
    types = dict(rows.dtypes)
    wanted = {f: i for i, f in enumerate(feeds)}

    def step(group, batches, state):
        at, total, ws, wf, wv, ds, dv, blocked = state.get if state.exists else (first, 0.0, [], [], [], [], [], "")
        waiting = {(s, f): v for s, f, v in zip(ws, wf, wv, strict=True)}
        done = {s: list(dv[i * len(feeds) : (i + 1) * len(feeds)]) for i, s in enumerate(ds)}
        out = []
        got = pd.concat(list(batches)).sort_values([session, feed, value])
        for s, f, v in zip(got[session], got[feed], got[value], strict=True):
            if f not in wanted or pd.isna(v) or math.isinf(v):
                continue
            s, v = int(s), float(v)
            if s >= at:
                waiting[s, f] = v
            elif s in done and done[s][wanted[f]] != v:
                out.append((s, "revision", f, v, done[s][wanted[f]], None, None))
        while all((at, f) in waiting for f in feeds):
            values = [waiting.pop((at, f)) for f in feeds]
            total += values[0] - sum(values[1:])
            done[at] = values
            out.append((at, "issued", None, values[0] - sum(values[1:]), None, at - first + 1, total))
            at += 1
        missing = [f for f in feeds if (at, f) not in waiting]
        says = f"{at}:{','.join(missing)}" if waiting else ""
        if says and says != blocked:
            out += [(at, "blocked", f, None, None, None, None) for f in missing]
        kept = sorted(done)[-recall:]
        left = sorted(waiting)
        state.update((at, total, [s for s, _ in left], [f for _, f in left], [waiting[k] for k in left], kept, [v for s in kept for v in done[s]], says))
        frame = pd.DataFrame(out, columns=["session", "kind", "feed", "value", "archived", "n", "total"])
        frame.insert(0, key, group[0])
        yield frame.astype({"session": "int64", "n": "Int64"}) if len(frame) else frame.astype({"session": "int64"})

    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {types[key]}, {OUT}", STATE, "append", GroupStateTimeout.NoTimeout)
