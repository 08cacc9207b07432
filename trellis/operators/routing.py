"""Route search for one district and one strategy: sequential by nature, so it runs as one grouped function per
(district, strategy), many at a time.

Points are connected one after another in the strategy's order. Each search runs over a visibility graph (corners of
obstacles moved out by their clearance, and places to cross zones squarely), with states (vertex, vertex before) so that no turn
exceeds a right angle, toward whatever ends cheapest: an existing chamber, an existing pipe (new chamber), a node
or an edge of the network built so far (branch chamber). Distances are true distances, not polygonal buffers.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

from trellis.functions import tables as T
from trellis.operators.geometry import Shape, angle, crossings, project, zone

SLACK, MAX_APPROACHES, MAX_EXPANSIONS = 0.05, 12, 200_000
#: Distance of the places tried along an existing pipe, beside its vertices and the nearest place.
SAMPLE = 50.0
#: How much farther than the nearest a wall may be without a reason given.
FARTHER = 0.05
_DN = [row[0] for row in T.DIAMETERS]
_ROW = {row[0]: row for row in T.DIAMETERS}


def smallest(flow: float, length: float = 0.0) -> int | None:
    """Smallest diameter for a flow, and a run's length if given."""
    return next((dn for dn, cap, run, *_ in T.DIAMETERS if flow <= cap and length <= run), None)


def chamber_price(dn: int) -> float:
    """Cost of a new chamber."""
    return next((c for limit, c in T.CHAMBER_BANDS if dn <= limit), T.CHAMBER_TOP)


@dataclass
class Obstacle:
    key: str
    kind: str
    shape: Shape
    special: bool
    base: float
    min_angle: float | None
    margin: float
    k: float
    depth: float | None = None
    height: float = 0.0
    vertical: float = 0.0
    under_only: bool = False
    pipe: bool = False

    def reach(self, dn: int) -> float:
        """Clearance of the pipe's axis: the rule's, by diameter for buildings, and half the channel's width."""
        base = (5.0 if dn < 500 else 7.0 if dn <= 800 else 9.0) if self.kind == "oks" else self.base
        return base + _ROW[dn][4] / 2


@dataclass
class Node:
    key: str
    kind: str  # point, chamber, tie-in, branch
    at: np.ndarray
    old_dn: int = 0
    old_degree: int = 0
    pipe: str | None = None


@dataclass
class Edge:
    up: str
    down: str
    line: list
    flow: float = 0.0
    dn: int = 0


@dataclass
class District:
    pipes: list
    chambers: list
    points: list
    obstacles: list[Obstacle]

    @staticmethod
    def load(rows: list[dict], profile: str = "heat") -> District:
        """From typed feature rows (object_type, id_key, coords as nested lists, and so on)."""
        rules = {row[0]: row for row in T.RULES[profile]}
        of = lambda k: [r for r in rows if r["object_type"] == k]
        pipes = [(r["id_key"], np.array(r["coords"]), int(r["diameter"])) for r in of("heat_network")]
        obstacles = []
        for r in of("restriction"):
            kind = str(r["restriction_type"]).strip().lower()
            kind = T.ALIASES.get(kind, kind)
            rule = rules.get(kind, T.unknown_rule(profile))
            g, c = r["geometry_type"], r["coords"]
            parts = {"Polygon": lambda c: [c], "MultiPolygon": lambda c: c, "LineString": lambda c: [[c]], "MultiLineString": lambda c: [[x] for x in c]}[g](c)
            obstacles.append(Obstacle(r["id_key"], kind, Shape([[np.array(x) for x in p] for p in parts], "Polygon" in g), rule[1] == "special", rule[2], rule[3], rule[4], rule[5], rule[8], rule[7] or 0.0, rule[9] or 0.0, rule[10]))
        rule = rules["heat_network"]
        for key, line, dn in pipes:
            obstacles.append(Obstacle(key, "heat_network", Shape([[line]], False), True, rule[2], None, rule[4], rule[5], rule[8], _ROW[dn][5], rule[9], False, True))
        chambers = [(r["id_key"], np.array(r["coords"])) for r in of("heat_chamber")]
        points = [(r["id_key"], np.array(r["coords"]), float(r["flow"])) for r in of("oks_connection_point")]
        return District(pipes, chambers, points, obstacles)

    def pipes_at(self, at, eps: float = 0.02) -> tuple[int, int]:
        """Largest diameter and number of ends of existing pipes at a place; a pipe that passes counts twice."""
        dn = degree = 0
        for _, line, d in self.pipes:
            if min(np.hypot(*(project(at, a, b)[0] - at)) for a, b in zip(line, line[1:])) <= eps:
                dn = max(dn, d)
                degree += 1 if min(np.hypot(*(line[0] - at)), np.hypot(*(line[-1] - at))) <= eps else 2
        return dn, degree


@dataclass
class Builder:
    """Grows the network of one strategy."""

    district: District
    dn: int = 100
    nodes: dict[str, Node] = field(default_factory=dict)
    edges: list[Edge] = field(default_factory=list)
    missed: list[str] = field(default_factory=list)
    reasons: dict[str, str] = field(default_factory=dict)
    made: int = 0
    pinned: frozenset = frozenset()
    excluded: frozenset = frozenset()

    def allowed(self, key: str) -> bool:
        """Whether routes may tie in to an existing chamber or pipe; ids are compared as text."""
        return key[2:] not in self.excluded and (not self.pinned or key[2:] in self.pinned)

    # ---- legality

    def crossed(self, p, q, exempt: frozenset, start_free: bool = False) -> list[tuple[float, float, Obstacle]] | None:
        """Special stretches of the segment, or None if it may not be laid. exempt obstacles are not asked."""
        out = []
        length = float(np.hypot(*(q - p)))
        if length < 1e-6:
            return []
        for o in self.district.obstacles:
            if o.key in exempt:
                continue
            need = o.reach(self.dn)
            far = max(need, o.margin)
            if o.shape.box_distance(p, q) >= far:
                continue
            if not o.special:
                if o.shape.segment_distance(p, q) < need - 1e-6:
                    return None
                continue
            meets = crossings(p, q, o.shape.a, o.shape.b)
            if not len(meets):
                if o.shape.segment_distance(p, q) < need - 1e-6:
                    return None
                continue
            if o.shape.distance(p) < o.margin - 1e-6 or o.shape.distance(q) < o.margin - 1e-6:
                return None
            if o.min_angle:
                for _, k in meets:
                    a = angle(q - p, o.shape.b[int(k)] - o.shape.a[int(k)])
                    if min(a, 180 - a) < o.min_angle - 0.02:
                        return None
            out += [(a, b, o) for a, b in zone(o.shape, p, q, o.margin)]
        for e in self.edges:  # new pipes may only meet at their nodes
            for a, b in zip(e.line, e.line[1:]):
                for t, _ in crossings(p, q, a[None], b[None]):
                    if 1e-6 < t < 1 - 1e-6:
                        return None
        return out

    def price(self, p, q, stretches, flow: float) -> float:
        length, cost = float(np.hypot(*(q - p))), _ROW[smallest(flow) or _DN[-1]][3]
        return cost * (length + sum((b - a) * (o.k - 1) for a, b, o in stretches))

    # ---- vertices

    def corners(self, near: list[np.ndarray]) -> list[np.ndarray]:
        """Corners of obstacles moved out by their clearance, and square crossings of special zones opposite the places given."""
        out = []
        for o in self.district.obstacles:
            d = (max(o.reach(self.dn), o.margin) if o.special else o.reach(self.dn)) + SLACK
            if o.special:
                for a, b in zip(o.shape.a, o.shape.b):
                    n = float(np.hypot(*(b - a)))
                    if n < 1e-6:
                        continue
                    u = (b - a) / n
                    normal = np.array([-u[1], u[0]])
                    for p in near:
                        t = float((p - a) @ u)
                        if 0 <= t <= n:
                            out += [a + t * u + normal * d, a + t * u - normal * d]
            for part in o.shape.parts:
                for ring in part:
                    closed = o.shape.area
                    pts = ring[:-1] if closed else ring
                    for i, v in enumerate(pts):
                        before = pts[i - 1] if closed or i else None
                        behind = pts[(i + 1) % len(pts)] if closed or i + 1 < len(pts) else None
                        dirs = [x / (np.hypot(*x) or 1) for x in ([v - before] if before is not None else []) + ([behind - v] if behind is not None else [])]
                        normals = [np.array([-x[1], x[0]]) for x in dirs]
                        s = sum(normals)
                        n2 = float(s @ s)
                        if n2 > 1e-9:
                            miter = s / n2 * (2 if len(normals) == 2 else 1)
                            if np.hypot(*miter) > 2:
                                miter = miter / np.hypot(*miter) * 2
                            out += [v + miter * d, v - miter * d]
                        if not closed and len(dirs) == 1:
                            tip = dirs[0] if before is not None else -dirs[0]
                            out += [v + tip * d + normals[0] * d, v + tip * d - normals[0] * d]
        return out

    def approaches(self, at: np.ndarray) -> list[tuple[float, np.ndarray, frozenset]]:
        """Distance of the wall and place outside to start from, nearest wall first, with the areas that the final section may cross."""
        holding = [o for o in self.district.obstacles if o.shape.area and not o.special and o.shape.covers(at)]
        if not holding:
            return [(0.0, at, frozenset())]
        free = frozenset(o.key for o in holding)
        building = min(holding, key=lambda o: (o.kind != "oks", float(np.prod(o.shape.high - o.shape.low))))
        found = []
        for a, b in zip(building.shape.a, building.shape.b):
            foot, _ = project(at, a, b)
            gap = float(np.hypot(*(foot - at)))
            if gap < 1e-6:
                continue
            u, reach = (foot - at) / gap, gap
            for o in holding:
                beyond = [float(t) for t, _ in crossings(at, at + u * 5000, o.shape.a, o.shape.b)]
                if o is building:
                    reach = max(reach, gap + (o.reach(self.dn) + SLACK))
                elif beyond:
                    reach = max(reach, min(beyond) * 5000 + o.reach(self.dn) + SLACK)
            place = at + u * reach
            if any(o.shape.distance(place) < o.reach(self.dn) - 1e-6 for o in holding) or any(np.hypot(*(place - p)) < 1 for _, p, _ in found):
                continue
            found.append((gap, place, free))
        return sorted(found, key=lambda x: x[0])[:MAX_APPROACHES]

    # ---- goals

    def degree(self, key: str) -> int:
        return self.nodes[key].old_degree + sum(key in (e.up, e.down) for e in self.edges) if key in self.nodes else 0

    def goals(self, start: np.ndarray, flow: float) -> list[tuple[np.ndarray, str, object, float, frozenset]]:
        """(place, what, which, added cost, obstacles that the last segment may touch)."""
        out = []
        touching = lambda at: frozenset(k for k, line, _ in self.district.pipes if min(np.hypot(*(project(at, a, b)[0] - at)) for a, b in zip(line, line[1:])) < 0.02)
        usable = []
        for key, at in self.district.chambers:
            dn, old = self.district.pipes_at(at)
            if dn and max(old, self.degree(key)) < T.MAX_LINKS:
                usable.append(at)
                if self.allowed(key):
                    out.append((at, "chamber", key, T.TIE_IN_COST, touching(at)))
        for key, line, dn in self.district.pipes:
            if not self.allowed(key):
                continue
            for a, b in zip(line, line[1:]):
                at, _ = project(start, a, b)
                length = float(np.hypot(*(b - a)))
                for place in [at, a, *(a + (b - a) * t for t in np.arange(SAMPLE, length, SAMPLE) / (length or 1))]:
                    if all(np.hypot(*(place - c)) > T.SNAP + 0.5 for c in usable) and all(np.hypot(*(place - n.at)) > T.SNAP for n in self.nodes.values() if n.kind == "tie-in") and all(np.hypot(*(place - e)) > 0.5 for e in (line[0], line[-1])):
                        out.append((place, "tie-in", key, chamber_price(max(dn, self.dn)), touching(place)))
        above = {e.down: e for e in self.edges}

        def upsize(key):
            total = 0.0
            while key in above:
                e = above[key]
                length = sum(float(np.hypot(*(b - a))) for a, b in zip(e.line, e.line[1:]))
                total += length * (_ROW[smallest(e.flow + flow) or _DN[-1]][3] - _ROW[smallest(e.flow) or _DN[-1]][3])
                key = e.up
            return total

        for n in self.nodes.values():
            if n.kind in ("tie-in", "branch") and self.degree(n.key) < T.MAX_LINKS:
                out.append((n.at, "node", n.key, upsize(n.key), touching(n.at)))
        for e in self.edges:
            for i, (a, b) in enumerate(zip(e.line, e.line[1:])):
                length = float(np.hypot(*(b - a)))
                if length < 6:
                    continue
                zones = self.special_zones(a, b)
                s = float(np.clip(project(start, a, b)[1] * length, 2.0, length - 2.0))
                for x in {s, length / 2}:
                    if not any(lo - 0.5 <= x <= hi + 0.5 for lo, hi in zones):
                        out.append((a + (b - a) * (x / length), "edge", (e, i), chamber_price(self.dn) + upsize(e.down), frozenset()))
        return out

    def special_zones(self, a, b) -> list[tuple[float, float]]:
        """Stretches of a segment in special zones, where no chamber may stand."""
        return [(x, y) for o in self.district.obstacles if o.special and not o.pipe for x, y in zone(o.shape, a, b, o.margin)]

    # ---- search

    def route(self, at: np.ndarray, flow: float):
        """Cheapest legal line from a goal to the point, or None: (cost, line from goal to point, goal)."""
        self.dn = smallest(flow) or _DN[-1]
        chosen, nearest = None, None
        for gap, start, free in self.approaches(at):
            nearest = gap if nearest is None else nearest
            if chosen and gap > chosen[0] + 0.5:  # a farther wall only if no nearer one can be reached
                break
            last = self.crossed(at, start, free)
            if last is None:
                continue
            goals = self.goals(start, flow)
            corners = self.corners([start, *(g[0] for g in goals)])
            vertices = [start, *corners, *(g[0] for g in goals)]
            first_goal = 1 + len(corners)
            place = np.array(vertices)
            done: dict[tuple[int, int], float] = {}
            heap = [(0.0, 0, -1, None)]
            known: dict[tuple[int, int], object] = {}
            rate = _ROW[self.dn][3]
            expansions = 0
            best = None
            while heap and expansions < MAX_EXPANSIONS:
                cost, v, before, trail = heapq.heappop(heap)
                if best and cost >= best[0]:
                    break
                if (v, before) in done:
                    continue
                done[v, before] = cost
                if v >= first_goal:
                    g = goals[v - first_goal]
                    best = (cost, (v, trail), g)
                    break
                expansions += 1
                incoming = place[v] - (place[before] if before >= 0 else at)
                for w in range(1, len(vertices)):
                    if w == v or w == before:
                        continue
                    d = place[w] - place[v]
                    n = float(np.hypot(*d))
                    if n < 0.5 or (np.hypot(*incoming) > 1e-6 and angle(incoming, d) > T.MAX_TURN + 1e-3):
                        continue
                    extra = goals[w - first_goal][3] if w >= first_goal else 0.0
                    if best and cost + n * rate + extra >= best[0]:
                        continue
                    if (v, w) not in known:
                        exempt = goals[w - first_goal][4] if w >= first_goal else frozenset()
                        s = self.crossed(place[v], place[w], exempt)
                        known[v, w] = None if s is None else self.price(place[v], place[w], s, flow)
                    price = known[v, w]
                    if price is not None:
                        heapq.heappush(heap, (cost + price + extra, w, v, (v, trail)))
            if best:
                chain, line = best[1], []
                while chain is not None:
                    line.append(place[chain[0]])
                    chain = chain[1]
                if np.hypot(*(at - start)) > 1e-6:
                    line.append(at)
                cost = best[0] + self.price(at, start, last, flow)
                if chosen is None or cost < chosen[1]:
                    chosen = (gap, cost, _straightened(line), best[2])
        #: Whether a farther wall than the nearest had to be taken.
        self.farther = chosen is not None and chosen[0] > nearest + FARTHER
        return chosen and chosen[1:]

    def connect(self, key: str, at: np.ndarray, flow: float) -> None:
        found = self.route(at, flow)
        if found is None or smallest(flow) is None:
            self.missed.append(key)
            return
        if self.farther:
            self.reasons[key] = "no route through the nearest wall"
        _, line, (place, what, which, _, _) = found
        if what == "chamber":
            root = which
            if root not in self.nodes:
                self.nodes[root] = Node(root, "chamber", place, *self.district.pipes_at(place))
        elif what == "tie-in":
            root = self._new("tie-in", place, which)
        elif what == "node":
            root = which
        else:
            edge, i = which
            root = self._new("branch", place, None)
            lower = Edge(root, edge.down, [place, *edge.line[i + 1 :]], edge.flow)
            edge.line, edge.down = [*edge.line[: i + 1], place], root
            self.edges.append(lower)
        self.nodes[key] = Node(key, "point", at)
        self.edges.append(Edge(root, key, line, 0.0))
        above = {e.down: e for e in self.edges}
        while key in above:
            above[key].flow += flow
            key = above[key].up

    def _new(self, kind: str, place, pipe) -> str:
        self.made += 1
        key = f"s:new_{kind.replace('-', '_')}_{self.made}"
        old = self.district.pipes_at(place) if kind == "tie-in" else (0, 0)
        self.nodes[key] = Node(key, kind, place, *old, pipe)
        return key

    # ---- polish

    def polish(self) -> None:
        """Leave out inner vertices where the straight line is legal and no dearer."""
        for e in self.edges:
            i = 1
            while i < len(e.line) - 1:
                a, b, c = e.line[i - 1 : i + 2]
                turns = [(e.line[i - 2], a, c)] if i > 1 else []
                turns += [(a, c, e.line[i + 2])] if i + 2 < len(e.line) else []
                self.dn, own = smallest(e.flow) or _DN[-1], self.edges
                self.edges = [x for x in own if x is not e]
                straight, first, second = self.crossed(a, c, frozenset()), self.crossed(a, b, frozenset()), self.crossed(b, c, frozenset())
                self.edges = own
                fits = straight is not None and first is not None and second is not None and all(angle(y - x, z - y) <= T.MAX_TURN for x, y, z in turns)
                if fits and self.price(a, c, straight, e.flow) <= self.price(a, b, first, e.flow) + self.price(b, c, second, e.flow):
                    del e.line[i]
                else:
                    i += 1

    # ---- sizes

    def size(self) -> None:
        """Diameters: smallest by flow, no smaller toward the root, next one up where a run of one diameter is too long."""
        place = {e.down: i for i, e in enumerate(self.edges)}
        length = [float(np.hypot(*np.diff(np.array(e.line), axis=0).T).sum()) for e in self.edges]
        start = [_DN.index(smallest(e.flow) or _DN[-1]) for e in self.edges]
        for e, step in zip(self.edges, sized(length, [place.get(e.up) for e in self.edges], start)):
            e.dn = _DN[step]


def sized(length: list[float], above: list[int | None], step: list[int]) -> list[int]:
    """Rows of the diameter table for the edges of a forest, raised from ``step`` as far as needed. above: the edge toward the root.

    The longest run of one diameter through an edge is the deepest that hangs on it plus what is above it, by two sweeps over
    the forest. Every edge with too long a run goes up by one row, until none has; the result depends on no order of edges.
    """
    depth: dict[int, int] = {}
    for i in range(len(above)):
        trail = []
        while i is not None and i not in depth:
            trail.append(i)
            i = above[i]
        base = -1 if i is None else depth[i]
        depth |= {e: base + n + 1 for n, e in enumerate(reversed(trail))}
    down = sorted(depth, key=depth.get)
    step, limit = list(step), [row[2] + 1e-9 for row in T.DIAMETERS]
    while True:
        for i in reversed(down):
            if above[i] is not None:
                step[above[i]] = max(step[above[i]], step[i])
        alike = [above[i] is not None and step[above[i]] == step[i] for i in range(len(above))]
        hanging, over = list(length), [0.0] * len(above)
        for i in reversed(down):
            if alike[i]:
                hanging[above[i]] = max(hanging[above[i]], length[above[i]] + hanging[i])
        for i in down:
            if alike[i]:
                over[i] = over[above[i]] + length[above[i]]
        long = [i for i in down if step[i] + 1 < len(limit) and hanging[i] + over[i] > limit[step[i]]]
        if not long:
            return step
        for i in long:
            step[i] += 1


def _straightened(line: list[np.ndarray]) -> list[np.ndarray]:
    out = [line[0]]
    for i in range(1, len(line) - 1):
        if np.hypot(*(line[i] - out[-1])) > 1e-6 and angle(line[i] - out[-1], line[i + 1] - line[i]) > 1e-6:
            out.append(line[i])
    return [*out, line[-1]]


def order(points: list, strategy: str, pipes: list) -> list:
    """Points in a strategy's order."""
    near = {k: min(float(np.hypot(*(project(at, a, b)[0] - at))) for _, line, _ in pipes for a, b in zip(line, line[1:])) for k, at, _ in points}
    if strategy == "flow":
        return sorted(points, key=lambda p: (-p[2], p[0]))
    if strategy == "nearest":
        return sorted(points, key=lambda p: (near[p[0]], p[0]))
    if strategy == "farthest":
        return sorted(points, key=lambda p: (-near[p[0]], p[0]))
    out = sorted(points, key=lambda p: p[0])
    generator = Lcg(1_000_003 * int(strategy.rpartition("-")[2] or 0) + 17)
    for i in range(len(out) - 1, 0, -1):
        j = generator.below(i + 1)
        out[i], out[j] = out[j], out[i]
    return out


class Lcg:
    """The 48-bit linear congruential generator of java.util.Random, so that seeds give the same orders everywhere."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def bits(self, n: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return self.state >> (48 - n)

    def below(self, bound: int) -> int:
        if bound & -bound == bound:
            return (bound * self.bits(31)) >> 31
        while True:
            b = self.bits(31)
            if b - b % bound + bound - 1 < 1 << 31:
                return b % bound


def profile(length: float, needs: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """(place, depth) breakpoints along an edge: default depth, ramps of the greatest slope to each stretch that asks for less."""
    if not needs:
        return [(0.0, T.DEPTH), (length, T.DEPTH)]
    at = {0.0, length}
    for lo, hi, d in needs:
        ramp = (T.DEPTH - d) / T.SLOPE
        at |= {max(0.0, lo - ramp), lo, hi, min(length, hi + ramp)}
    lines = sorted(needs)
    for (_, h1, d1), (l2, _, d2) in zip(lines, lines[1:]):
        meet = (h1 + l2 + (d2 - d1) / T.SLOPE) / 2
        if h1 < meet < l2:
            at.add(meet)
    depth = lambda s: min([T.DEPTH, *(d + T.SLOPE * max(lo - s, s - hi, 0.0) for lo, hi, d in needs)])
    return [(s, depth(s)) for s in sorted(at)]


def pieces(builder: Builder, edge: Edge, depths: bool) -> list[dict]:
    """An edge cut where its laying changes (special stretches, straight) and, with depths, where its slope changes."""
    line = edge.line
    at = np.cumsum([0.0, *(float(np.hypot(*(b - a))) for a, b in zip(line, line[1:]))])
    total = float(at[-1])
    builder.dn = edge.dn
    roots = {n.pipe for n in builder.nodes.values() if n.pipe} | {k for k, l, _ in builder.district.pipes if edge.up in builder.nodes and min(np.hypot(*(project(builder.nodes[edge.up].at, a, b)[0] - builder.nodes[edge.up].at)) for a, b in zip(l, l[1:])) < 0.02}
    stretches = []
    for i, (a, b) in enumerate(zip(line, line[1:])):
        for o in builder.district.obstacles:
            if o.special and o.key not in roots and o.shape.box_distance(a, b) < o.margin and len(crossings(a, b, o.shape.a, o.shape.b)):
                stretches += [(at[i] + x, at[i] + y, o) for x, y in zone(o.shape, a, b, o.margin)]
    needs = []
    if depths:
        for lo, hi, o in stretches:
            if o.depth is not None and not o.under_only:
                top = o.depth - o.vertical - _ROW[edge.dn][5] - 0.01
                if T.MIN_DEPTH <= top < T.DEPTH:
                    needs.append((lo, hi, round(top, 4)))
    bends = profile(total, needs)
    cuts = sorted({0.0, total, *(x for s in stretches for x in s[:2]), *(s for s, _ in bends)})
    cuts = [c for i, c in enumerate(cuts) if i == 0 or c - cuts[i - 1] > 1e-6]
    depth = lambda s: float(np.interp(s, [x for x, _ in bends], [d for _, d in bends]))

    def where(s):
        i = min(int(np.searchsorted(at, s, "right")) - 1, len(line) - 2)
        return line[i] + (line[i + 1] - line[i]) * ((s - at[i]) / (at[i + 1] - at[i]))

    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        over = [o for a, b, o in stretches if a <= (lo + hi) / 2 <= b]
        k = max((o.k for o in over), default=1.0)
        d1, d2 = depth(lo), depth(hi)
        middle = (d1 + d2) / 2
        k_depth = 1.0 if not depths or middle <= T.DEPTH else 1 + 0.1 * (middle - T.DEPTH)
        shape = [where(lo), *(p for p, s in zip(line, at) if lo + 1e-9 < s < hi - 1e-9), where(hi)]
        out.append({
            "line": [p.tolist() for p in shape], "flow": edge.flow, "diameter": edge.dn, "length": hi - lo, "laying": "special" if over else "base", "k_special": k, "k_depth": k_depth,
            "depth_start": d1 if depths else None, "depth_end": d2 if depths else None, "crossed": ",".join(sorted({o.kind for o in over})), "cost": (hi - lo) * _ROW[edge.dn][3] * k * k_depth,
        })
    return out


def solve(rows: list[dict], strategy: str, mode: str = "PLAN_2D", profile: str = "heat", pinned: frozenset = frozenset(), excluded: frozenset = frozenset()) -> list[dict]:
    """Network of one district by one strategy, as rows of pipes, chambers, technical nodes and missed points; ties in to pinned objects only, if any, and to none excluded."""
    district = District.load(rows, profile)
    if not district.pipes:
        return []
    b = Builder(district, pinned=pinned, excluded=excluded)
    for key, at, flow in order(district.points, strategy, district.pipes):
        b.connect(key, at, flow)
    b.polish()
    b.size()
    out, n = [], 0
    for e in b.edges:
        parts = pieces(b, e, mode == "DEPTH_3D")
        ends = [e.up]
        for p in parts[1:]:
            n += 1
            ends.append(f"s:tech_{n}")
            out.append({"kind": "technical_node", "key": ends[-1], "line": [p["line"][0]]})
        ends.append(e.down)
        for i, p in enumerate(parts):
            out.append({"kind": "pipe", "key": f"s:pipe_{len(out) + 1}", "start": ends[i], "end": ends[i + 1], "approach": b.reasons.get(ends[i + 1])} | p)
    for node in b.nodes.values():
        if node.kind in ("tie-in", "branch"):
            dn = max([node.old_dn, *(e.dn for e in b.edges if node.key in (e.up, e.down))])
            out.append({"kind": "chamber", "key": node.key, "line": [node.at.tolist()], "diameter": dn, "cost": chamber_price(dn), "tie_in_pipe": node.pipe})
        elif node.kind == "chamber":
            out.append({"kind": "existing_tie_in", "key": node.key, "line": [node.at.tolist()], "flow": float(sum(node.key in (e.up, e.down) for e in b.edges)), "cost": T.TIE_IN_COST * sum(node.key in (e.up, e.down) for e in b.edges)})
    flows = {k: f for k, _, f in district.points}
    out += [{"kind": "unconnected", "key": k, "flow": flows[k], "cost": T.PENALTY_BASE + T.PENALTY_PER_FLOW * flows[k]} for k in b.missed]
    return out
