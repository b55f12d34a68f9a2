"""Sequential models of the order-dependent rules, written for the tests only."""

from difflib import SequenceMatcher


def keep_first(rows):
    """rows: (pos, ext_key or None, hash_key) -> kept positions."""
    ext, hashes, out = set(), set(), []
    for pos, e, h in sorted(rows):
        if (e is not None and e in ext) or h in hashes:
            continue
        if e is not None:
            ext.add(e)
        hashes.add(h)
        out.append(pos)
    return out


def plan(stored, scraped, today):
    """One venue. stored/scraped: lists of dicts -> (updates, inserts, superseded, expired, skipped)."""
    updates, inserts, superseded = {}, set(), set()
    claimed = set()
    protected = lambda r: r["is_manually_created"] or r["duplicate_of_id"] is not None
    for s in sorted(scraped, key=lambda s: s["pos"]):
        hits = [
            r for r in stored if r["id"] not in claimed and (
                (s["external_id"] and r["external_id"] == s["external_id"] and r["date"] == s["date"])
                or r["hash"] == s["hash"])
        ]
        if not hits:
            inserts.add(s["pos"])
            continue
        hits.sort(key=lambda r: (
            r["duplicate_of_id"] is not None, not r["is_manually_created"], r["hash"] != s["hash"],
            -r["updated_at"].toordinal(), r["id"]))
        updates[hits[0]["id"]] = s["pos"]
        claimed.update(r["id"] for r in hits)
        superseded.update(r["id"] for r in hits[1:] if not protected(r))
    if not scraped:
        return {}, set(), set(), set(), False
    horizon = max(s["date"] for s in scraped)
    window = [r for r in stored if today <= r["date"] <= horizon]
    orphans = {r["id"] for r in window if r["id"] not in claimed and not protected(r)}
    skipped = len(orphans) > 4 and len(orphans) > len(window) * 0.5
    return updates, inserts, superseded, set() if skipped else orphans, skipped


def clusters(rows, min_length=6):
    """One night. rows: (id, title, markers, start) -> {id: founder id} for clusters of two or more."""
    groups = []
    for row in sorted(rows, key=lambda r: (len(r[1]), r[0])):
        home = None
        for g in groups:
            for other in g:
                a, b = row[1], other[1]
                if not a or not b or min(len(a), len(b)) < min_length or not (a in b or b in a):
                    continue
                if row[2] != other[2] and row[3] is not None and other[3] is not None and row[3] != other[3]:
                    continue
                home = g
                break
            if home is not None:
                break
        if home is None:
            groups.append([row])
        else:
            home.append(row)
    return {r[0]: g[0][0] for g in groups if len(g) > 1 for r in g}


def best_similarity(titles):
    best = 0.0
    for j in range(len(titles)):
        for i in range(j):
            a, b = titles[i], titles[j]
            if a and b:
                best = max(best, 1.0 if a == b else SequenceMatcher(None, a, b).ratio())
    return best


def admissions(rows, pending, listed, queued, cap):
    """rows: (seq, who, key); pending: {who: n}; -> {seq: reason or None}."""
    out, mine, keys = {}, dict(pending), set(queued)
    for seq, who, key in sorted(rows):
        if mine.get(who, 0) >= cap:
            out[seq] = "too many pending"
        elif key in listed:
            out[seq] = "already listed"
        elif key in keys:
            out[seq] = "already pending"
        else:
            out[seq] = None
            mine[who] = mine.get(who, 0) + 1
            keys.add(key)
    return out
