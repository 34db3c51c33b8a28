"""From annotation tables to the identity file and matched annotations."""

from letterflow.operators.dates import normalise_annotations
from letterflow.operators.identity import (
    KEY, bucketed_identity, identity_file, individuals, match_identity)
from letterflow.sources.sink import new_folder


def link(tables, as_of, path=None, hot=None):
    """Normalise every table, build the identity file once and match all tables to it.

    `tables` maps kinds to scanned annotations. The identity file is kept in the new folder
    `path`, which all executors share, in buckets of the person keys: each table is shuffled
    to it once, and the file itself never again. `hot` maps kinds to their common
    identities, as from `hot_keys`. Returns (identity file, {kind: matched annotations}).
    """
    hot = hot or {}
    clean = {kind: normalise_annotations(df) for kind, df in tables.items()}
    first = next(iter(tables.values()))
    path = path or new_folder(first.sparkSession, "identity")
    identity = bucketed_identity(identity_file(individuals(clean), as_of, path), f"{path}/bucketed")
    return identity.drop(KEY), {kind: match_identity(df, identity, hot=hot.get(kind))
                                for kind, df in clean.items()}
