"""A change log as plain lists: what the operators must agree with."""


def newest(log, snapshot):
    best = {}
    for key, seq, vtype, value in log:
        if seq <= snapshot and (key not in best or seq > best[key][0]):
            best[key] = (seq, vtype, value)
    return best


def live(log, snapshot):
    return {k: v for k, (_, t, v) in newest(log, snapshot).items() if t == 1}


def compact(log, smallest, bottom, drop=True):
    """The entries that one pass over the sorted log keeps."""
    kept, last_key, newer = [], None, None
    for key, seq, vtype, value in sorted(log, key=lambda e: (e[0], -e[1])):
        if key != last_key:
            last_key, newer = key, None
        hidden = newer is not None and newer <= smallest
        newer = seq
        if hidden or drop and bottom and vtype == 0 and seq <= smallest:
            continue
        kept.append((key, seq, vtype, value))
    return kept
