"""Small sequential models, written from the definitions, that the distributed operators are compared with."""

import heapq

MIN = 60_000_000


def release(rows, k):
    """Rows ``(ts, arrival, id)`` in the order a reorder buffer of size k releases them."""
    buffer, out = [], []
    for n, (ts, _, event) in enumerate(sorted(rows, key=lambda r: (r[1], r[2]))):
        heapq.heappush(buffer, (ts, n, event))
        if len(buffer) >= k:
            out.append(heapq.heappop(buffer))
    while buffer:
        out.append(heapq.heappop(buffer))
    return out


def classify(released, lateness):
    newest, out = None, []
    for ts, n, event in released:
        newest = ts if newest is None else max(newest, ts)
        label = "on_time" if ts >= newest - lateness else "late_ok" if ts >= newest - 2 * lateness else "late_drop"
        out.append((ts, event, label))
    return out


def buckets(rows, gap, cap, key_of):
    """``{event: (key, bucket start, parent start)}``; ``gap`` may be a number or one number per row."""
    open_, placed = {}, {}
    for i, (ts, event) in enumerate(rows):
        key, g = key_of[event], gap[i] if isinstance(gap, list) else gap
        b = open_.get(key)
        if b is not None and ts - b["end"] <= g and (cap is None or ts - b["start"] <= cap):
            b["end"] = max(b["end"], ts)
        else:
            parent = b["start"] if b is not None and ts - b["end"] <= g else None
            open_[key] = b = {"start": ts, "end": ts, "parent": parent}
        placed[event] = (key, b["start"], b["parent"])
    return placed


def adaptive(times, base_us, alpha=0.1):
    lo, hi, cur = base_us * 0.5, base_us * 1.5, float(base_us)
    last = mean = ema = None
    warm, out = [], []
    for t in times:
        if last is not None and t > last:
            gap = (t - last) / 1e6
            if mean is None:
                warm.append(gap)
                if len(warm) == 100:
                    mean = ema = sum(warm) / 100
            else:
                ema = alpha * gap + (1 - alpha) * ema
                ratio = mean / ema
                if ratio >= 3.0:
                    cur = max(cur * 0.8, lo)
                elif ratio <= 0.33:
                    cur = min(cur * 1.2, hi)
        last = t
        out.append(cur)
    return out
