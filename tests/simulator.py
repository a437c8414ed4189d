"""A plain Python account of conflicts and plans, for tests only: dictionaries and an explicit dependency queue."""

from collections import deque


def ahead(a, b):
    return any(n > b.get(k, 0) for k, n in a.items())


def dominates(a, b):
    return ahead(a, b) and not ahead(b, a)


def concurrent(a, b):
    return ahead(a, b) and ahead(b, a)


def join(*vectors):
    out = {}
    for v in vectors:
        for k, n in v.items():
            out[k] = max(out.get(k, 0), n)
    return out


def conflicts(files):
    """files: drive -> path -> row (hash, mtime, vv, tombstone)."""
    out = {}
    for path in sorted({p for rows in files.values() for p in rows}):
        have = [(d, files[d][path]) for d in sorted(files) if path in files[d]]
        for i, (_, x) in enumerate(have):
            for _, y in have[i + 1 :]:
                up = dominates(x["vv"], y["vv"]) and not x["tombstone"] and y["tombstone"]
                down = dominates(y["vv"], x["vv"]) and not y["tombstone"] and x["tombstone"]
                if concurrent(x["vv"], y["vv"]) or up or down:
                    out[path] = have
    return out


def resolve(have, total):
    for d, x in have:
        if all(not ahead(y["vv"], x["vv"]) for _, y in have):
            return d, "DOMINANT_VERSION"
    for h in sorted({x["hash"] for _, x in have if not x["tombstone"]}):
        agree = [d for d, x in have if x["hash"] == h and not x["tombstone"]]
        if len(agree) * 2 > total:
            return agree[0], "MAJORITY_QUORUM"
    for d, x in have:
        if x["tombstone"]:
            return d, "TOMBSTONE_WINS"
    best = max((x["mtime"] for _, x in have), default=0)
    if best > 0:
        return next(d for d, x in have if x["mtime"] == best), "LAST_WRITE_WINS"
    return "", "COPY_ALL_VERSIONS"


def above(path):
    parts = path.split("/")
    return ["/".join(parts[:n]) for n in range(len(parts) - 1, 0, -1)]


def plan(files, winners, scope):
    """winners: (path, drive) in the order of paths. Returns (type, source, target, path, new path, vector) in order."""
    drives, ops, made, spared = sorted(files), [], set(), set()
    live = {d: {p for p, r in files[d].items() if not r["tombstone"]} for d in drives}

    def folders(path, target):
        for folder in above(path):
            if (target, folder) not in made:
                made.add((target, folder))
                ops.append(("MKDIR", "", target, folder, None, {}))

    moved = {}
    for s in drives:
        for t in drives:
            for old in sorted(live[t]):
                gone = files[s].get(old)
                if s == t or not gone or not gone["tombstone"]:
                    continue
                names = [n for n in live[s] - live[t] if files[s][n]["hash"] == files[t][old]["hash"] and n != old]
                if names:
                    moved[t, old] = max(names)
    for (t, old), new in sorted(moved.items()):
        s = next(d for d in drives if d != t and new in live[d])
        folders(new, t)
        ops.append(("RENAME", s, t, old, new, join(*[files[d][p]["vv"] for d in drives for p in (old, new) if p in files[d]])))
        spared |= {(t, old), (t, new)}
    for path in sorted({p for rows in files.values() for p in rows}):
        have = {d: files[d][path] for d in drives if path in files[d]}
        dead = [d for d in have if have[d]["tombstone"]]
        if len(dead) * 2 > len(drives):
            ops += [("REMOVE", dead[0], t, path, None, join(*[have[d]["vv"] for d in dead])) for t in drives if path in live[t] and (t, path) not in spared]
            continue
        order = [w for p, w in winners if w and (scope == "reference" or p == path)]
        src = next((w for w in order if w in have and any(concurrent(have[w]["vv"], r["vv"]) for d, r in have.items() if d != w)), None)
        if src is None:
            for d in have:
                if src is None or dominates(have[d]["vv"], have[src]["vv"]):
                    src = d
        vector = join(*[r["vv"] for r in have.values()])
        for t in drives:
            if t == src or (t, path) in spared:
                continue
            if have[src]["tombstone"]:
                if path in live[t]:
                    ops.append(("REMOVE", src, t, path, None, vector))
            elif path not in live[t]:
                folders(path, t)
                ops.append(("COPY", src, t, path, None, vector))
            elif dominates(have[src]["vv"], have[t]["vv"]) or have[src]["hash"] != have[t]["hash"]:
                ops.append(("REPLACE", src, t, path, None, vector))
    return last_only(queue(ops))


def queue(ops):
    """First in, first out among operations whose directories are already there."""
    waits = [0] * len(ops)
    after = [[] for _ in ops]
    for i, (kind, _, target, path, *_) in enumerate(ops):
        if kind == "MKDIR":
            for j, other in enumerate(ops):
                if other[2] == target and other[3].startswith(path + "/"):
                    after[i].append(j)
                    waits[j] += 1
    ready, out = deque(i for i, n in enumerate(waits) if not n), []
    while ready:
        i = ready.popleft()
        out.append(ops[i])
        for j in after[i]:
            waits[j] -= 1
            if not waits[j]:
                ready.append(j)
    return out


def last_only(ops):
    last = {(o[2], o[3]): i for i, o in enumerate(ops)}
    return [o for i, o in enumerate(ops) if last[o[2], o[3]] == i]
