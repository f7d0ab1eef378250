"""State machines that are followed in order: leases and token buckets. Used by the batch twins and by keyed state."""

from __future__ import annotations


class Leases:
    """Leases under a global cap and one a node; 0 means no cap."""

    def __init__(self, total: int, per_node: int, ttl_s: float):
        self.total, self.per_node, self.ttl = total, per_node, ttl_s
        self.held: dict[str, tuple[str, float]] = {}

    def step(self, kind: str, node: str, lease: str, now: float) -> bool:
        self.held = {k: v for k, v in self.held.items() if now <= v[1]}
        if kind == "release":
            return self.held.pop(lease, None) is not None
        if kind == "renew":
            if lease not in self.held:
                return False
        elif lease not in self.held:
            if self.total and len(self.held) >= self.total:
                return False
            if self.per_node and sum(n == node for n, _ in self.held.values()) >= self.per_node:
                return False
        self.held[lease] = (node, now + self.ttl)
        return True


class Bucket:
    def __init__(self, rate: float, burst: float, now: float | None = None):
        self.rate, self.burst, self.tokens, self.last = rate, burst, burst, now

    def refill(self, now: float) -> bool:
        self.tokens = min(self.burst, self.tokens + self.rate * (now - (self.last if self.last is not None else now)))
        self.last = now
        return self.tokens >= 1


class Buckets:
    """One bucket for all, then one an address; the oldest address goes when there are too many."""

    def __init__(self, rate: float, burst: float, global_rate: float, global_burst: float, most: int):
        self.rate, self.burst, self.most = rate, burst, most
        self.all = Bucket(global_rate, global_burst)
        self.by: dict[str, Bucket] = {}

    def allow(self, ip: str, now: float) -> bool:
        if not self.all.refill(now):
            return False
        if ip not in self.by:
            if len(self.by) >= self.most:
                del self.by[next(iter(self.by))]
            self.by[ip] = Bucket(self.rate, self.burst, now)
        if not self.by[ip].refill(now):
            return False
        self.by[ip].tokens -= 1
        self.all.tokens -= 1
        return True
