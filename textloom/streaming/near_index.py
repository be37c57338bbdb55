"""Near-duplicate index over a stream: a text joins the first band's head it meets, or becomes a head itself.

Only heads enter the index, in the order of arrival, so it is not the transitive closure that batch clusters give. The
state is kept by partition key (a teacher, a category), which bounds it by that key's heads.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "id long, grp string, head long"
STATE = "bands map<string, long>"


def assign(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    heads: dict[str, int] = dict(state.get[0]) if state.exists else {}
    rows = pd.concat(list(batches)).sort_values("id")
    out = []
    for i, bands in zip(rows["id"].tolist(), rows["bands"].tolist(), strict=True):
        names = [f"{n}:{b}" for n, b in enumerate(bands)]
        head = next((heads[n] for n in names if n in heads), None)
        if head is None:
            heads |= dict.fromkeys(names, i)
        out.append((i, key[0], i if head is None else head))
    state.update((heads,))
    yield pd.DataFrame(out, columns=["id", "grp", "head"])


def near_heads(stream: DataFrame) -> DataFrame:
    """From rows (id long, grp string, bands array<string>) the head of each; its own id if it is one."""
    return stream.groupBy("grp").applyInPandasWithState(assign, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def first_of_band(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    head = state.get[0] if state.exists else None
    ids = [i for b in batches for i in b["id"].tolist()]
    head = min(ids) if head is None else head
    state.update((head,))
    yield pd.DataFrame({"id": ids, "grp": key[0], "head": head})


def band_heads(stream: DataFrame) -> DataFrame:
    """From rows (id long, grp string, bands array<string>) a row (id, grp, head) for each band: the first id that came with it.

    The state of one band key is one number, and keys are dealt over all tasks, so no group's index is held in one place.
    Unlike in near_heads every text enters the index; the least head of an id is what it is near to.
    """
    keys = stream.select("id", "grp", F.posexplode("bands").alias("n", "b")).select("id", "grp", F.concat_ws(":", "n", "b").alias("band"))
    return keys.groupBy("grp", "band").applyInPandasWithState(first_of_band, OUT, "head long", "append", GroupStateTimeout.NoTimeout)
