"""The same results in SQL, written independently of the DataFrame code, to check it with another engine.

Every text is one query over the plain input tables. Shared steps are common table expressions put in front.
"""

from __future__ import annotations


def distance(lat_a: str, lon_a: str, lat_b: str, lon_b: str) -> str:
    """Metres between two points in degrees."""
    ra, rb = 6378140, 6356755
    pa = f"atan({rb / ra!r}::double*tan(radians({lat_a})))"
    pb = f"atan({rb / ra!r}::double*tan(radians({lat_b})))"
    f8 = f"{(ra - rb) / ra / 8!r}::double"
    return (
        f"(select case when h = 0 then 1e-7 else {ra}::double*(x + {f8}*((sin(x)-x)*(sa+sb)*(sa+sb)/(1-h)"
        f" - (sin(x)+x)*(sa-sb)*(sa-sb)/h)) end from (select h, sa, sb, 2*asin(sqrt(h)) x from (select"
        f" least(1::double, pow(sin(({pb}-{pa})/2),2)"
        f" + cos({pa})*cos({pb})*pow(sin((radians({lon_b})-radians({lon_a}))/2),2)) h, sin({pa}) sa, sin({pb}) sb)))"
    )


def metres(lat_a: str, lon_a: str, lat_b: str, lon_b: str) -> str:
    return f"cast(round_even({distance(lat_a, lon_a, lat_b, lon_b)}, 0) as bigint)"


def metres_e5(lat_a: str, lon_a: str, lat_b: str, lon_b: str) -> str:
    return metres(*[f"({c}/1e5)" for c in (lat_a, lon_a, lat_b, lon_b)])


def geohash(lat: str, lon: str, digits: int = 9) -> str:
    """Geohash text by halving bit after bit: longitude and latitude cell indexes, then five interleaved bits per digit."""
    bx, by = (5 * digits + 1) // 2, 5 * digits // 2
    x = f"least({2**bx - 1}, (({lon}+18000000)*{2**bx})//36000000)"
    y = f"least({2**by - 1}, (({lat}+9000000)*{2**by})//18000000)"
    out = []
    for d in range(digits):
        bits = []
        for b in range(5):
            i = 5 * d + b
            src, total = (x, bx) if i % 2 == 0 else (y, by)
            bits.append(f"((({src}) >> {total - 1 - i // 2}) & 1)*{2 ** (4 - b)}")
        out.append(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', cast(1+{'+'.join(bits)} as bigint), 1)")
    return "(" + "||".join(out) + ")"


TRIPS = """
base as (
  select event_id, user_id, ts, cast(regexp_extract(props,'[0-9]+') as int) k,
         cast(round(value*100) as int) cents, 3+(user_id*7)%45 n from events),
anchored as (select *, case when k<70 then (hour(ts)//8 + 3*(case when isodow(ts)>=6 then 1 else 0 end)) % n
                     else (k*13+cents) % n end anchor from base),
places as (select *, 3000000+(user_id%50)*2000+(anchor%7)*1500+(cents%3)*150 la,
                11400000+(user_id%40)*2500+(anchor//7)*2000+(cents%4)*200 lo from anchored),
trips as materialized (
select event_id r_key, user_id out_id, ts start_time, ts + to_seconds(60+cents%7200) end_time,
       lag(la) over w start_lat_e5, lag(lo) over w start_lon_e5, la end_lat_e5, lo end_lon_e5
from places window w as (partition by user_id order by ts, event_id)
qualify lag(la) over w is not null)
"""

SPLIT = """
ranked as (select *, row_number() over (partition by out_id order by start_time desc, r_key) newest,
  count(*) over (partition by out_id) n from trips),
labelled as materialized (select * exclude (newest, n) from ranked where newest > n//5),
targets as materialized (select * exclude (newest, n) from ranked where newest <= n//5)
"""


def calendar_columns(ts: str = "start_time") -> str:
    return (
        f"cast(isodow({ts})-1 as bigint) weekday, cast((isodow({ts})-1)//5 as bigint) weekend,"
        f" cast(hour({ts})*100 + round_even(minute({ts})*100/60, 0) as bigint) hour_c"
    )


def zones(src: str, threshold: str = "500", keys: str = "out_id") -> str:
    """Addresses to merged zones. ``threshold`` is a number or a column of ``src``."""
    carried = "" if threshold.isnumeric() else f", {threshold}"
    k = keys
    on = lambda a, b: " and ".join(f"{a}.{c.strip()}={b}.{c.strip()}" for c in k.split(","))
    ka = ", ".join(f"a.{c.strip()}" for c in k.split(","))
    kb = ", ".join(f"b.{c.strip()}" for c in k.split(","))
    kc = ", ".join(f"c.{c.strip()}" for c in k.split(","))
    return f"""
addr as materialized (select distinct {k}, end_lat_e5 lat_e5, end_lon_e5 lon_e5{carried} from {src}),
prev as (select *, lag(lat_e5) over w plat, lag(lon_e5) over w plon from addr
  window w as (partition by {k} order by lat_e5, lon_e5)),
gaps as materialized (select * exclude (plat, plon), case when plat is null then null else
  {metres_e5('plat', 'plon', 'lat_e5', 'lon_e5')} end distance_gap from prev),
azones as materialized (select *, cast(100 + sum(case when distance_gap > {threshold} then 1 else 0 end) over
  (partition by {k} order by lat_e5, lon_e5) as bigint) zoneid from gaps),
cent as materialized (select {k}, zoneid, sum(lat_e5)/count(*)/1e5 center_lat, sum(lon_e5)/count(*)/1e5 center_lon
  {', any_value(threshold) threshold' if carried else f', {threshold} threshold'} from azones group by all),
cr as materialized (select *, row_number() over (partition by {k} order by center_lon, center_lat, zoneid) rk from cent),
pairs as materialized (select {kb}, a.rk rka, b.rk rkb, a.zoneid za, b.zoneid zb,
  {metres('a.center_lat', 'a.center_lon', 'b.center_lat', 'b.center_lon')} d
  from cr a join cr b on {on('a', 'b')} and a.rk < b.rk
  where round_even(abs(a.center_lon-b.center_lon)*1e5, 0) <= 2*a.threshold),
reach as materialized (select * from pairs p where d <= (select any_value(threshold) from cr c where {on('c', 'p')})),
earlier as materialized (select {k}, rkb rk, list(rka) earlier from reach group by all),
fold as (
  select distinct {k}, 0::bigint rk, []::bigint[] kept, null::bigint target from cr
  union all
  select {kc}, c.rk, case when list_min(list_intersect(coalesce(e.earlier, []), f.kept)) is null
      then list_append(f.kept, c.rk) else f.kept end,
    list_min(list_intersect(coalesce(e.earlier, []), f.kept))
  from fold f join cr c on {on('f', 'c')} and c.rk = f.rk+1
  left join earlier e on {on('e', 'c')} and e.rk = c.rk),
mergemap as materialized (select {kb}, b.zoneid, a.zoneid zoneid_new, p.d cur_dis
  from fold f join cr b on {on('f', 'b')} and f.rk=b.rk join cr a on {on('a', 'f')} and a.rk=f.target
  join pairs p on {on('p', 'f')} and p.rka=f.target and p.rkb=f.rk where f.target is not null),
moved as materialized (select a.* exclude (zoneid, distance_gap), a.zoneid zoneid_raw, coalesce(m.zoneid_new, a.zoneid) zoneid
  from azones a left join mergemap m on {on('a', 'm')} and a.zoneid=m.zoneid),
mcent as (select {k}, zoneid, sum(lat_e5)/count(*)/1e5 center_lat, sum(lon_e5)/count(*)/1e5 center_lon from moved group by all),
merged as materialized (select m.*, c.center_lat, c.center_lon,
  {metres('c.center_lat', 'c.center_lon', '(m.lat_e5/1e5)', '(m.lon_e5/1e5)')} distance_2_center
  from moved m join mcent c on {on('m', 'c')} and m.zoneid=c.zoneid),
ends as (select {k}, start_lat_e5 lat_e5, start_lon_e5 lon_e5, 1 o, 0 i from {src} union all
  select {k}, end_lat_e5, end_lon_e5, 0, 1 from {src}),
traffic as materialized (select {ka}, a.zoneid, cast(sum(o) as bigint) "out", cast(sum(i) as bigint) "in",
  cast(count(*) as bigint) in_out from merged a join ends e on {on('a', 'e')} and a.lat_e5=e.lat_e5 and a.lon_e5=e.lon_e5 group by all),
freq as materialized (select *, cast(sum("in") over w as bigint) in_total, cast(sum("out") over w as bigint) out_total,
  cast(sum(in_out) over w as bigint) in_out_total,
  "in"/nullif(sum("in") over w, 0) in_per, "out"/nullif(sum("out") over w, 0) out_per,
  in_out/nullif(sum(in_out) over w, 0) in_out_per,
  row_number() over (partition by {k} order by in_out desc, zoneid)-1 sn from traffic window w as (partition by {k})),
dict as materialized (select {ka}, a.lat_e5, a.lon_e5, a.zoneid, sn, center_lat, center_lon, distance_2_center, "out", "in",
  in_out, in_total, out_total, in_out_total, in_per, out_per, in_out_per
  from merged a left join freq f on {on('a', 'f')} and a.zoneid=f.zoneid),
zlist as materialized (select distinct {k}, zoneid, center_lat, center_lon, sn, in_out from dict)
"""


def snapped(src: str, name: str, sides=("start", "end"), keys: str = "out_id") -> str:
    columns, joins = "", ""
    for s in sides:
        columns += (
            f", {s}_d.zoneid {s}_zoneid, {s}_d.sn {s}_sn, {s}_d.center_lat {s}_lat_adj, {s}_d.center_lon {s}_lon_adj"
        )
        on = " and ".join(f"t.{c.strip()}={s}_d.{c.strip()}" for c in keys.split(","))
        joins += f" left join dict {s}_d on {on} and t.{s}_lat_e5={s}_d.lat_e5 and t.{s}_lon_e5={s}_d.lon_e5"
    return f"{name} as materialized (select t.*{columns} from {src} t{joins})"


def center_distances(src: str, name: str, top: int) -> str:
    tops = ", ".join(
        f"max(center_lat) filter (sn={i}) tlat{i}, max(center_lon) filter (sn={i}) tlon{i}" for i in range(top + 1)
    )
    lat, lon = "coalesce(s.start_lat_adj, s.start_lat_e5/1e5)", "coalesce(s.start_lon_adj, s.start_lon_e5/1e5)"
    plain = [
        f"case when tlat{i} is null then null else {metres(lat, lon, f'tlat{i}', f'tlon{i}')} end d{i}" for i in range(top)
    ]
    filled = ", ".join(f"coalesce({', '.join(f'd{j}' for j in range(i, -1, -1))}) dis_center_{i}" for i in range(top))
    drop = ", ".join([f"tlat{i}, tlon{i}" for i in range(top + 1)] + [f"d{i}" for i in range(top)])
    return f"""{name}_tops as materialized (select out_id, {tops} from zlist group by out_id),
{name}_m as (select s.*, t.* exclude (out_id), {', '.join(plain)} from {src} s join {name}_tops t using (out_id)),
{name} as materialized (select * exclude ({drop}), {filled} from {name}_m)"""


BASE = ["weekday", "weekend", "start_lat_e5", "start_lon_e5", "hour_c"]
KNN = [*BASE, "dis_center_1", "dis_center_2"]

EXAMPLES = f"""
aged as (select *, row_number() over (partition by out_id order by start_time, r_key) oldest,
  count(*) over (partition by out_id) n from labelled),
validated as materialized (select * exclude (oldest, n), case when oldest > n*4//5 then 1 else 0 end validate from aged),
{snapped('validated', 'ksnap')},
{center_distances('ksnap', 'kcent', 3)},
known as materialized (select *, {calendar_columns()} from kcent),
{snapped('targets', 'tsnap', ('start',))},
{center_distances('tsnap', 'tcent', 3)},
hidden as materialized (select *, {calendar_columns()} from tcent),
train as materialized (
  select 'validate' fold, out_id, r_key, {', '.join(KNN)}, end_zoneid from known where validate=0 union all
  select 'final', out_id, r_key, {', '.join(KNN)}, end_zoneid from known),
queries as materialized (
  select 'validate' fold, out_id, r_key, {', '.join(KNN)} from known where validate=1 union all
  select 'final', out_id, r_key, {', '.join(KNN)} from hidden)
"""


def deviations(src: str, columns, keys: str, name: str = "dev") -> str:
    parts = ", ".join(
        f"cast(sum({c}) as double)/count(*) mean_{c},"
        f" coalesce(nullif(sqrt(cast(count(*)*sum({c}::hugeint*{c})-sum({c})*sum({c}) as double))/count(*), 0), 1) std_{c}"
        for c in columns
    )
    return f"{name} as materialized (select {keys}, {parts} from {src} group by all)"


def neighbours(k: int, p: int, columns, name: str, train="train", queries="queries", keys="fold, out_id", dev="dev") -> str:
    on = lambda a, b: " and ".join(f"{a}.{c.strip()}={b}.{c.strip()}" for c in keys.split(","))
    kq = ", ".join(f"q.{c.strip()}" for c in keys.split(","))
    gaps = ", ".join(f"abs(q.{c}-t.{c})/d.std_{c} g{i}" for i, c in enumerate(columns))
    total = "+".join("(" + "*".join([f"g{i}"] * p) + ")" for i in range(len(columns)))
    return f"""{name}_pairs as (select {kq}, q.r_key, t.r_key p_id, t.end_zoneid zoneid, {gaps}
  from {queries} q join {train} t on {on('q', 't')} join {dev} d on {on('q', 'd')}),
{name}_near as (select {keys}, r_key, zoneid, {total} far, row_number() over (partition by {keys}, r_key order by {total}, p_id) rank
  from {name}_pairs qualify rank <= {k}),
{name} as materialized (select {keys}, r_key, zoneid, count(*)/sum(count(*)) over (partition by {keys}, r_key) p
  from {name}_near group by {keys}, r_key, zoneid)"""


MODELS = f"""
{deviations('train', KNN, 'fold, out_id')},
{neighbours(19, 5, KNN, 'k0')},
{neighbours(5, 2, KNN, 'k1')},
{neighbours(1, 2, KNN, 'k2')},
common as (select fold, out_id, end_zoneid zoneid, row_number() over (partition by fold, out_id order by count(*) desc, end_zoneid) c
  from train group by fold, out_id, end_zoneid qualify c = 1),
probs as materialized (
  select 'm0' model, * from k0 union all select 'm1', * from k1 union all select 'm2', * from k2 union all
  select 'm3', q.fold, q.out_id, q.r_key, c.zoneid, 1::double from queries q join common c using (fold, out_id))
"""

def boosted(rounds: int, depth: int, rate: float = 0.3, shrink: float = 1.0, least: float = 1.0, units: int = 1 << 20) -> str:
    """Boosted trees, round after round and level after level, one row per trip and zone: margins ``bm0`` to ``bm{rounds}``."""
    key, double = "fold, out_id, r_key", lambda c: f"(cast({c} as double)/{units}.0::double)"
    fall = lambda g, h: f"({double(g)}*{double(g)}/({double(h)}+{shrink}::double))"
    value = lambda g, h: f"(({-rate!r}::double*{double(g)})/({double(h)}+{shrink}::double))"
    steps = [f"""
brows as materialized (select {key}, [{', '.join(BASE)}] xs, end_zoneid label from train
  union all select {key}, [{', '.join(BASE)}], null from queries),
bx as materialized (select {key}, unnest(range({len(BASE)})) feature, unnest(xs) v from brows where label is not null),
bm0 as materialized (select {key}, zone, 0::double m from brows join (select distinct fold, out_id, end_zoneid zone from train) using (fold, out_id))"""]
    for r in range(1, rounds + 1):
        steps.append(f"""
be{r} as (select *, exp(m - max(m) over (partition by {key})) e from bm{r - 1}),
bp{r} as (select *, e / sum(e) over (partition by {key}) p from be{r}),
bg{r} as materialized (select {key}, zone, cast(round_even((p - case when zone = label then 1 else 0 end)*{units}, 0) as bigint) g,
  greatest(cast(round_even(p*(1 - p)*2*{units}, 0) as bigint), 1) h from bp{r} join brows using ({key}) where label is not null),
bn{r}_0 as (select {key}, zone, 0 node, -1::double v from bm{r - 1})""")
        for i in range(depth):
            node = "fold, out_id, zone, node"
            root = f"""
br{r} as materialized (select fold, out_id, zone, {value('sum(g)', 'sum(h)')} v from bg{r} group by all),""" if i == 0 else ""
            before = f"(select n.* exclude (v), br.v from bn{r}_0 n join br{r} br using (fold, out_id, zone))" if i == 0 else f"bn{r}_{i}"
            steps.append(f"""{root}
bh{r}_{i} as materialized (select {node}, feature, v, sum(g) g, sum(h) h from (select * exclude (v) from bn{r}_{i}) join bg{r} using ({key}, zone) join bx using ({key})
  where node >= 0 group by all),
bs{r}_{i} as (select *, lead(v) over o nv, sum(g) over o gl, sum(h) over o hl, sum(g) over t gt, sum(h) over t ht from bh{r}_{i}
  window o as (partition by {node}, feature order by v rows between unbounded preceding and current row), t as (partition by {node}, feature)),
bc{r}_{i} as materialized (select *, {fall('gl', 'hl')}+{fall('(gt-gl)', '(ht-hl)')}-{fall('gt', 'ht')} gain, {value('gl', 'hl')} lv, {value('(gt-gl)', '(ht-hl)')} rv
  from bs{r}_{i} where nv is not null and least({double('hl')}, {double('(ht-hl)')}) >= {least}
  qualify gain > 0 and row_number() over (partition by {node} order by gain desc, feature, v) = 1),
bn{r}_{i + 1} as materialized (select n.fold, n.out_id, n.r_key, n.zone,
    case when c.feature is null then -1 when 2*xs[feature+1] > c.v + nv then 2*n.node + 1 else 2*n.node end node,
    case when c.feature is null then n.v when 2*xs[feature+1] > c.v + nv then rv else lv end v
  from {before} n join brows using ({key}) left join bc{r}_{i} c using ({node}))""")
        steps.append(f"""
bm{r} as materialized (select {key}, zone, m + v m from bm{r - 1} join bn{r}_{depth} using ({key}, zone))""")
    return ",".join(steps)


def forest_sql(name: str, trees: int, depth: int, weight: str = "1", drawn: bool = False, keys: str = "out_id") -> str:
    """Trees grown level by level, in long form: ``{name}_splits{level}`` and ``{name}_each`` (keys, tree, r_key, zoneid, p) of the queries.

    Reads ``{name}_rows`` (keys, r_key, label), ``{name}_asked`` (keys, r_key), ``{name}_x`` (keys, r_key, feature, v; of both) and
    ``{name}_size`` (keys, n_features). ``weight`` may use tree and r_key.
    """
    node = f"{keys}, tree, node"
    steps = [f"""
{name}_0 as materialized (select {keys}, r_key, true learned, tree, label, {weight} w, 0 node, -1 stop from {name}_rows, range({trees}) t(tree) where {weight} > 0
  union all select {keys}, r_key, false, tree, null, 1, 0, -1 from {name}_asked semi join {name}_size using ({keys}), range({trees}) t(tree))"""]
    for i in range(depth):
        count = f"select {keys}, n.tree, n.node, x.feature, x.v, label, sum(w)::bigint w from {name}_{i} n join {name}_x x using ({keys}, r_key)"
        if drawn:
            steps.append(f"""
{name}_d{i} as materialized (select n_features, tree, node, feature from (select distinct n_features, tree, node from {name}_{i} join {name}_size using ({keys}) where learned and stop < 0),
    lateral (select unnest(range(n_features)) feature)
  qualify row_number() over (partition by n_features, tree, node order by md5('0:' || tree || ':{i}:' || node || ':' || feature)[1:8], feature) <= ceil(sqrt(n_features)))""")
            count += f" join {name}_size using ({keys}) join {name}_d{i} d using (n_features, tree, node, feature)"
        steps.append(f"""
{name}_h{i} as materialized ({count} where learned and stop < 0 group by all),
{name}_l{i} as (select *, coalesce(sum(w) over (partition by {node}, feature, label order by v rows between unbounded preceding and 1 preceding), 0) l,
  sum(w) over (partition by {node}, feature, label) t from {name}_h{i}),
{name}_v{i} as (select {node}, feature, v, sum(w) w, sum(2*l*w + w*w) ll, sum(t*w) tl from {name}_l{i} group by all),
{name}_c{i} as (select {node}, feature, v, lead(v) over o nv, sum(w) over o wl, sum(ll) over o sl, sum(tl) over o x, sum(w) over a w, sum(ll) over a s from {name}_v{i}
  window o as (partition by {node}, feature order by v rows between unbounded preceding and current row), a as (partition by {node}, feature)),
{name}_splits{i} as materialized (select *, cast(sl as double)/wl + cast(s - 2*x + sl as double)/(w - wl) score from {name}_c{i} where nv is not null and s < w*w
  qualify row_number() over (partition by {node} order by score desc, feature, v) = 1),
{name}_{i + 1} as materialized (select n.* exclude (node, stop),
    case when stop >= 0 or c.feature is null then n.node else 2*n.node + (2*coalesce(x.v, 0) > c.v + c.nv)::int end node,
    case when stop < 0 and c.feature is null then {i} else stop end stop
  from {name}_{i} n left join {name}_splits{i} c using ({node}) left join {name}_x x on x.feature = c.feature and x.r_key = n.r_key
    and {' and '.join(f'x.{k} = n.{k}' for k in keys.split(', '))})""")
    leaf = f"{keys}, tree, stop, node"
    steps.append(f"""
{name}_leaf as materialized (select {leaf}, label zoneid, sum(w)/sum(sum(w)) over (partition by {leaf}) p from {name}_{depth} where learned group by {leaf}, label),
{name}_each as materialized (select {keys}, tree, r_key, l.zoneid, p from (select * from {name}_{depth} where not learned) n join {name}_leaf l using ({leaf}))""")
    return ",".join(steps)


def hashed(*parts: str) -> str:
    return f"('0x' || md5({' || '.join(parts)})[1:8])::bigint"


POISSON = "(case " + " ".join(
    f"when {hashed(repr('0:'), 'tree', repr(':'), 'r_key')}/4294967296.0::double < {p} then {i}"
    for i, p in enumerate((0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941, 0.99992))
) + " else 7 end)"
FOLD = f"({hashed(repr('fold:'), 'r_key')} % 5)"


def long_features(src: str, columns, keys: str) -> str:
    return " union all ".join(f"select {keys}, r_key, {i} feature, cast({c} as bigint) v from {src}" for i, c in enumerate(columns))


def mean_of_trees(name: str, keys: str) -> str:
    return (
        f"select {keys}, r_key, zoneid, round(sum(p)/sum(sum(p)) over (partition by {keys}, r_key), 9) p from {name}_each"
        f" group by {keys}, r_key, zoneid"
    )


SCORES = f"""
picked as materialized (select model, fold, out_id, r_key, arg_max(zoneid, p*1000000-zoneid) predict_zone_id, max(p) p from probs group by all),
preds as materialized (select k.*, z.center_lat predict_lat, z.center_lon predict_lon
  from picked k join zlist z on k.out_id=z.out_id and k.predict_zone_id=z.zoneid),
missed as materialized (select p.*, t.end_zoneid, t.end_lat_e5, t.end_lon_e5,
  {distance('(t.end_lat_e5/1e5)', '(t.end_lon_e5/1e5)', 'p.predict_lat', 'p.predict_lon')} loss_dis
  from preds p join known t using (r_key) where p.fold='validate'),
scored as materialized (select *, cast(round_even(1e5/(1+exp((1000-loss_dis)/250)), 0) as bigint) loss_e5 from missed),
carloss as materialized (select out_id, model, sum(loss_e5)/count(*)/1e5 loss, count(*) trips from scored group by all),
best as materialized (select out_id, model, loss from carloss qualify row_number() over (partition by out_id order by loss, model)=1)
"""


def half_even(total: str, count: str) -> str:
    """Whole-number quotient rounded half to even."""
    return (
        f"(({total})//({count}) + case when 2*(({total})%({count})) > ({count}) or (2*(({total})%({count})) = ({count})"
        f" and (({total})//({count}))%2 = 1) then 1 else 0 end)"
    )


def query(*parts: str) -> str:
    """Join common table expressions and the final select."""
    return "with recursive " + ",\n".join(p.strip() for p in parts[:-1]) + "\n" + parts[-1].strip()


ZONES = zones("trips")
LZONES = zones("labelled")
TEXT_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
DIST = metres_e5("start_lat_e5", "start_lon_e5", "end_lat_e5", "end_lon_e5")
PROFILE = f"""
far as materialized (select *, {DIST} distance from trips),
profile as materialized (select out_id, min(distance) distance_min, max(distance) distance_max,
  cast(round_even(sum(distance)/count(*), 0) as bigint) distance_mean from far group by out_id)
"""
CALENDAR = """
calendar as (select * from (values (date '2024-01-01', '2'), (date '2024-01-14', '0')) v(date, code) union all
  select d::date, case when isodow(d)>=6 then '1' else '0' end from range(date '2024-01-01', date '2024-02-01', interval 1 day) r(d)
  where d not in (date '2024-01-01', date '2024-01-14'))
"""
GEO = "geo as materialized (select *, " + ", ".join(
    f"substr(s9,1,{p}) geo{p}, substr(e9,1,{p}) geo{p}_end" for p in range(4, 10)
) + f" from (select *, {geohash('start_lat_e5', 'start_lon_e5')} s9, {geohash('end_lat_e5', 'end_lon_e5')} e9 from trips))"


def geo_of(src: str, name: str) -> str:
    return GEO.replace("geo as", f"{name} as", 1).replace("from trips))", f"from {src}))")


GEO_COHORT = (
    "case when cells<=0 then -1 when cells<=20 then 0 when cells<=40 then 1 when cells<=60 then 2 when cells<=80 then 3"
    " when cells<=100 then 4 when cells<=900 then 5 else -1 end"
)
CELLS6 = f"cars6 as materialized (select out_id, count(distinct geo6_end) cells from geo group by out_id), cohort6 as materialized (select *, cast({GEO_COHORT} as bigint) cohort from cars6)"
QUANTILE = """
zcount as materialized (select out_id, count(distinct end_zoneid) zones from snap group by out_id),
edges as (select list_distinct([quantile_cont(zones, 0.2), quantile_cont(zones, 0.4), quantile_cont(zones, 0.6), quantile_cont(zones, 0.8)]) e from zcount),
qcohort as materialized (select out_id, zones, cast(len(list_filter(e, lambda x : x < zones)) as bigint) cohort from zcount, edges)
"""
SNAP = snapped("trips", "snap")
FEATURE_TRIPS = f"ft as materialized (select *, {calendar_columns()} from trips)"

_tree_features = {"weekday": 0, "weekend": 1, "hour_c": 2, "start_zoneid": 3}
TREE = f"""
tr as materialized (select out_id, {calendar_columns()}, coalesce(start_zoneid, 0) start_zoneid, end_zoneid label from snap),
tv as materialized ({' union all '.join(f"select out_id, {i} feature, {c} v, label from tr" for c, i in _tree_features.items())}),
vals as materialized (select distinct out_id, feature, v from tv),
cutv as materialized (select *, lead(v) over (partition by out_id, feature order by v) nv from vals),
tot as materialized (select out_id, label, count(*) t from tr group by all),
tsum as (select out_id, sum(t) w, sum(t*t) s from tot group by all),
tcount as materialized (select out_id, feature, v, label, count(*) c from tv group by all),
grid as materialized (select c.out_id, c.feature, c.v, c.nv, t.label from cutv c join tot t using (out_id)),
running as materialized (select g.*, cast(sum(coalesce(c, 0)) over (partition by g.out_id, g.feature, g.label order by g.v) as bigint) l
  from grid g left join tcount using (out_id, feature, v, label)),
lefts as (select * from running where nv is not null and l > 0),
cuts as (select l.out_id, l.feature, l.v, l.nv, sum(l) wl, sum(l*l) sl, sum(l*t) x from lefts l join tot using (out_id, label) group by all),
scoredcuts as (select c.*, w, s, cast(sl as double)/wl + cast(s-2*x+sl as double)/(w-wl) score from cuts c join tsum using (out_id) where s < w*w)
"""

SWEEP_RUNS = """(
  select run_id, cohort, case run_id when 'r0' then [200,300,400,450,550,450,450][case cohort when -1 then 7 else cohort+1 end]
    when 'r1' then 500 else case cohort when 0 then 300 else 400 end end threshold
  from (values ('r0'),('r1'),('r2')) r(run_id), range(-1, 6) c(cohort))"""
SWEEP = f"""
{geo_of('labelled', 'geo')},
{CELLS6},
sruns as (select * from {SWEEP_RUNS}),
saged as (select *, row_number() over (partition by out_id order by start_time, r_key) oldest, count(*) over (partition by out_id) n from labelled),
each as materialized (select s.* exclude (oldest, n), case when oldest > n*4//5 then 1 else 0 end validate, r.run_id, r.cohort, r.threshold::bigint threshold
  from saged s join cohort6 c using (out_id) join sruns r on r.cohort=c.cohort),
{zones('each', 'threshold', 'run_id, out_id')},
{snapped('each', 'esnap', ('end',), 'run_id, out_id')},
sx as materialized (select *, {calendar_columns()} from esnap),
strain as materialized (select * from sx where validate=0),
squery as materialized (select * exclude (end_zoneid) from sx where validate=1),
{deviations('strain', BASE, 'run_id, out_id', 'sdev')},
{neighbours(5, 2, BASE, 'sk', 'strain', 'squery', 'run_id, out_id', 'sdev')},
spick as materialized (select run_id, out_id, r_key, arg_max(zoneid, p*1000000-zoneid) predict_zone_id from sk group by all),
smiss as materialized (select k.*, x.cohort, x.end_zoneid, {distance('(x.end_lat_e5/1e5)', '(x.end_lon_e5/1e5)', 'z.center_lat', 'z.center_lon')} loss_dis
  from spick k join zlist z on k.run_id=z.run_id and k.out_id=z.out_id and k.predict_zone_id=z.zoneid
  join sx x on x.run_id=k.run_id and x.r_key=k.r_key),
sloss as materialized (select *, cast(round_even(1e5/(1+exp((1000-loss_dis)/250)), 0) as bigint) loss_e5 from smiss),
swept as materialized (select run_id, cohort::bigint cohort, count(*) trips, {half_even('sum(loss_e5)', 'count(*)')}/1e5 loss,
  {half_even('10000*sum(case when end_zoneid=predict_zone_id then 1 else 0 end)', 'count(*)')}/1e4 accuracy from sloss group by all)
"""

EVENTS_HOLED = """
holed as materialized (select event_id, case when event_id%17=0 then null when event_id%23=0 then 'infinity'::double else value end v,
  case when event_id%19=0 then null else event_type end t, case when event_id%13=0 then null else event_type end r,
  case when event_id%5=0 then 0 else 1 end tr from events)
"""

LABEL_ROWS = """
lab as materialized (select l.doc_id, l.quality, l.toxic, (d.n_chars%101)/100.0::double score from labels l join documents d using (doc_id))
"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    ts = TEXT_TS.format
    trip_cols = f"r_key, out_id, {ts('start_time')} start_time, {ts('end_time')} end_time, start_lat_e5, start_lon_e5, end_lat_e5, end_lon_e5"

    # sources
    q["trips_labelled"] = query(TRIPS, SPLIT, f"select {trip_cols} from labelled")
    q["trips_unlabelled"] = query(TRIPS, SPLIT, f"select r_key, out_id, {ts('start_time')} start_time, start_lat_e5, start_lon_e5 from targets")
    q["trips_csv_roundtrip"] = q["trips_labelled"]
    q["select_runs"] = query(
        TRIPS, SPLIT, LZONES, EXAMPLES, MODELS, SCORES,
        f"""select printf('%07.5f', {half_even('sum(loss_e5)', 'count(*)')}/1e5) || '_' || model || '_500_split_num5_geo0' model
        from scored where model in ('m0','m1','m2') group by scored.model order by 1 limit 2""",
    )
    q["bundle_roundtrip"] = query(
        TRIPS, SPLIT, LZONES, EXAMPLES, MODELS, SCORES,
        """select 'predictions' tab, model, count(*) n, count(distinct out_id) cars from preds where fold='final' group by all union all
        select 'probabilities_target', model, count(*), count(distinct out_id) from probs where fold='final' group by all union all
        select 'probabilities_train', model, count(*), count(distinct out_id) from probs where fold='validate' group by all union all
        select 'validation', model, count(*), count(distinct out_id) from scored group by all""",
    )

    # enrichment
    q["trip_distance"] = query(TRIPS, f"select r_key, out_id, {DIST} distance from trips")
    q["trip_calendar"] = query(
        TRIPS,
        f"select r_key, strftime(start_time, '%Y-%m-%d') start_base, day(start_time) \"day\", {calendar_columns()}, cast(hour(start_time)*100 + round_even(minute(start_time)*100/60, 0) as bigint)/100.0::double \"hour\" from trips",
    ).replace("hour_c, cast", "hour_c, cast")
    q["trip_holiday"] = query(
        TRIPS, CALENDAR,
        "select r_key, cast(case when c.code is null then (case when isodow(start_time)>=6 then 1 else 0 end) when c.code='0' then 0 else 1 end as bigint) holiday from trips t left join calendar c on c.date = t.start_time::date",
    )
    q["trip_hour_of_week"] = query(
        TRIPS, "select r_key, cast(date_diff('hour', date_trunc('week', start_time), date_trunc('hour', start_time)) as bigint) hour_wk from trips"
    )
    q["trip_duration"] = query(TRIPS, "select r_key, floor(epoch(end_time - start_time))/86400 duration from trips")
    q["trip_geohash"] = query(
        TRIPS, GEO, "select r_key, " + ", ".join(f"geo{p}, geo{p}_end" for p in range(4, 10)) + " from geo"
    )
    q["geohash_codes"] = query(
        TRIPS, GEO,
        "sides as (select distinct 'start' side, geo9 from geo union select distinct 'end', geo9_end from geo)",
        "select side, geo9, " + ", ".join(f"dense_rank() over (partition by side order by substr(geo9,1,{p}))-1 code{p}" for p in range(4, 10)) + " from sides",
    )
    q["far_trips"] = query(TRIPS, PROFILE, "select r_key, out_id, distance, cast(case when distance > 2*distance_mean then 1 else 0 end as bigint) far from far join profile using (out_id)")
    q["departure_time_gap"] = query(
        TRIPS, FEATURE_TRIPS,
        "lagged as (select r_key, out_id, hour_c, lag(hour_c) over (partition by out_id order by start_time, r_key) p from ft)",
        "select r_key, out_id, round_even(least(abs(hour_c-p), 2400-abs(hour_c-p))/24, 0)/100 time_gap from lagged",
    )
    q["weekly_trips"] = query(
        TRIPS,
        "w as (select out_id, cast(date_diff('day', date '2012-01-01', start_time::date)//7 as bigint) week_sn from trips)",
        "select out_id, week_sn, count(*) trips, strftime(date '2012-01-01' + cast(week_sn*7 as int), '%Y-%m-%d') week_start from w group by all",
    )
    fmt = lambda e: f"strftime({e}, '%Y-%m-%d')"
    d = "d"
    back = "date_trunc('month', (d - interval 2 month))::date"
    q["date_dimension"] = query(
        "days as (select distinct o_orderdate::date d from orders)",
        f"""select {fmt(d)} "date", cast(date_diff('day', date '2012-01-01', d) as bigint) days_since,
        cast(floor(date_diff('day', date '2012-01-01', d)/7) as bigint) week_sn,
        {fmt("date '2012-01-01' + 7*cast(floor(date_diff('day', date '2012-01-01', d)/7) as int)")} week_start,
        {fmt("date_trunc('week', d)")} monday, {fmt('d + cast(7-isodow(d) as int)')} sunday,
        {fmt('d + interval 1 month')} next_month, {fmt('last_day(d)')} month_end,
        {fmt(f'{back} + cast(7-isodow({back}) as int)')} shifted_sunday,
        {fmt(d)} from_text, {fmt("date_trunc('month', d)")} from_month_text, {fmt(d)} as_text from days""",
    )

    # profiles
    q["car_distance_profile"] = query(TRIPS, PROFILE, "select * from profile")
    q["trips_with_profile"] = query(TRIPS, PROFILE, "select r_key, out_id, distance, distance_min, distance_max, distance_mean from far join profile using (out_id)")
    q["score_cars"] = query(TRIPS, SPLIT, 'select out_id, count(*) "count" from targets group by all')
    q["trips_scored_cars"] = query(TRIPS, SPLIT, "select r_key, out_id from labelled where out_id in (select out_id from targets)")
    counts = ", ".join(f"count(distinct geo{p}{s}) geo{p}{s}" for s in ("", "_end") for p in range(4, 10))
    foot = f"footp as (select out_id, count(*) \"count\", {counts}, cast({GEO_COHORT.replace('cells', 'count(distinct geo6_end)')} as bigint) gp from geo group by out_id)"
    q["car_geo_footprint"] = query(TRIPS, GEO, foot, "select * from footp")
    train_names = ", ".join([f"f.{c} train_{c}" for c in ["count", "gp", *[f"geo{p}{s}" for s in ("", "_end") for p in range(4, 10)]]])
    test_names = ", ".join([f"g.{c} test_{c}" for c in ["count", *[f"geo{p}" for p in range(4, 10)]]])
    q["car_geo_footprint_both"] = query(
        TRIPS, SPLIT, "lab_part as (select * from labelled), tar_part as (select * from targets)",
        geo_of("lab_part", "geo"), geo_of("tar_part", "tgeo"), foot,
        f"tfoot as (select out_id, count(*) \"count\", {', '.join(f'count(distinct geo{p}) geo{p}' for p in range(4, 10))} from tgeo group by out_id)",
        f"select coalesce(f.out_id, g.out_id) out_id, {train_names}, {test_names} from footp f full join tfoot g on f.out_id=g.out_id",
    )
    q["rare_geo_cells"] = query(TRIPS, GEO, "select geo4_end, count(distinct out_id) cars, count(*) trips from geo group by all having count(distinct out_id)=1 and count(*)<=1")
    q["end_zone_profile"] = query(
        TRIPS, ZONES, SNAP,
        f"ez as (select out_id, end_zoneid, min(start_time) f, max(start_time) l, count(*) visits from snap group by all)",
        f"select r_key, out_id, end_zoneid, {ts('f')} first_visit, {ts('l')} last_visit, visits from snap join ez using (out_id, end_zoneid)",
    )
    measures = {"duration_s": "cast(floor(epoch(end_time-start_time)) as bigint)", "distance": DIST, "end_sn": "end_sn"}
    aggs = ", ".join(
        f"min({m})::double sz_{m}_min, max({m})::double sz_{m}_max, sum({m})/count({m}) sz_{m}_mean, sum({m})::double sz_{m}_sum" for m in measures
    )
    sz_cols = [f"sz_{m}_{a}" for m in measures for a in ("min", "max", "mean", "sum")] + ["sz_end_zoneid_nunique", "sz_end_zoneid_count", "sz_start_sn_max"]
    q["start_zone_profile"] = query(
        TRIPS, ZONES, SNAP,
        f"meas as materialized (select * exclude (end_sn), end_sn, {measures['duration_s']} duration_s, {DIST} distance from snap)",
        f"sz as (select out_id, start_zoneid, {aggs}, count(distinct end_zoneid)::double sz_end_zoneid_nunique, count(end_zoneid)::double sz_end_zoneid_count, max(start_sn)::double sz_start_sn_max from meas where start_zoneid is not null group by all)",
        f"jz as materialized (select r_key, m.out_id, {', '.join(sz_cols)} from meas m left join sz on m.out_id=sz.out_id and m.start_zoneid=sz.start_zoneid)",
        f"select r_key, out_id, {', '.join(f'round(coalesce({c}, avg({c}) over ()), 4) {c}' for c in sz_cols)} from jz",
    )

    # zones
    q["car_addresses"] = query(TRIPS, ZONES, "select * from addr")
    q["address_gaps"] = query(TRIPS, ZONES, "select * from gaps")
    q["car_thresholds"] = query(TRIPS, PROFILE, "select out_id, distance_mean, cast(greatest(500, least(5000, distance_mean//5)) as bigint) threshold from profile")
    q["address_zones"] = query(TRIPS, ZONES, "select out_id, lat_e5, lon_e5, zoneid from azones")
    q["zone_centers"] = query(
        TRIPS, ZONES,
        f"select a.out_id, a.lat_e5, a.lon_e5, a.zoneid, c.center_lat, c.center_lon, {metres('c.center_lat', 'c.center_lon', '(a.lat_e5/1e5)', '(a.lon_e5/1e5)')} distance_2_center from azones a join cent c using (out_id, zoneid)",
    )
    q["zone_merge_pairs"] = query(TRIPS, ZONES, "select out_id, za zoneid, zb zoneid_near, d distance from reach")
    q["zone_merge_map"] = query(TRIPS, ZONES, "select out_id, zoneid, zoneid_new, cur_dis from mergemap")
    q["zones_merged"] = query(TRIPS, ZONES, "select out_id, lat_e5, lon_e5, zoneid_raw, zoneid, center_lat, center_lon, distance_2_center from merged")
    q["zone_in_out"] = query(TRIPS, ZONES, 'select out_id, zoneid, "out", "in", in_out from traffic')
    q["zone_shares"] = query(TRIPS, ZONES, "select * exclude (sn) from freq")
    q["zone_rank"] = query(TRIPS, ZONES, "select out_id, zoneid, in_out, sn from freq")
    q["zone_drop_ratio"] = query(
        TRIPS, ZONES, "select out_id, zoneid, in_out, coalesce(in_out/lag(in_out) over (partition by out_id order by sn), 1) drop_percent from freq"
    )
    q["zone_dictionary"] = query(TRIPS, ZONES, "select * from dict")
    q["zone_dictionary_adaptive"] = query(
        TRIPS, PROFILE,
        "tthr as materialized (select t.*, cast(greatest(500, least(5000, distance_mean//5)) as bigint) threshold from trips t join profile using (out_id))",
        zones("tthr", "threshold"), "select * from dict",
    )
    q["trips_snapped"] = query(TRIPS, ZONES, SNAP, "select r_key, out_id, start_zoneid, start_sn, start_lat_adj, start_lon_adj, end_zoneid, end_sn, end_lat_adj, end_lon_adj from snap")
    q["center_gaps"] = query(
        TRIPS, ZONES,
        "lg as (select *, lag(center_lat) over w plat, lag(center_lon) over w plon from zlist window w as (partition by out_id order by center_lon, center_lat, zoneid))",
        f"select out_id, zoneid, case when plat is null then null else {metres('plat', 'plon', 'center_lat', 'center_lon')} end distance_gap from lg",
    )
    q["zone_center_list"] = query(TRIPS, ZONES, "select * from zlist")
    q["zone_distance_matrix"] = query(
        TRIPS, ZONES, SNAP,
        "want as (select distinct out_id, start_zoneid, end_zoneid from snap where start_zoneid is not null and end_zoneid is not null)",
        f"select w.out_id, start_zoneid zoneid_a, end_zoneid zoneid_b, {metres('a.center_lat', 'a.center_lon', 'b.center_lat', 'b.center_lon')} distance from want w join zlist a on a.out_id=w.out_id and a.zoneid=w.start_zoneid join zlist b on b.out_id=w.out_id and b.zoneid=w.end_zoneid",
    )
    q["zones_knn_reduced"] = query(
        TRIPS, ZONES,
        "nz as (select out_id, count(distinct zoneid) nz from dict group by all)",
        "mk as materialized (select d.*, nz >= 20 and coalesce(in_out,0) < 4 rare, nz from dict d join nz using (out_id))",
        """near as (select r.out_id, r.lat_e5, r.lon_e5, k.zoneid zn from mk r join mk k on r.out_id=k.out_id and r.rare and not k.rare
          qualify row_number() over (partition by r.out_id, r.lat_e5, r.lon_e5 order by (r.lat_e5-k.lat_e5)*(r.lat_e5-k.lat_e5)+(r.lon_e5-k.lon_e5)*(r.lon_e5-k.lon_e5), k.lat_e5, k.lon_e5)=1)""",
        "nw as materialized (select mk.out_id, mk.lat_e5, mk.lon_e5, coalesce(zn, mk.zoneid) zoneid from mk left join near using (out_id, lat_e5, lon_e5))",
        "nc as (select out_id, zoneid, sum(lat_e5)/count(*)/1e5 center_lat, sum(lon_e5)/count(*)/1e5 center_lon from nw group by all)",
        f"select n.out_id, n.lat_e5, n.lon_e5, n.zoneid, c.center_lat, c.center_lon, {metres('c.center_lat', 'c.center_lon', '(n.lat_e5/1e5)', '(n.lon_e5/1e5)')} distance_2_center from nw n join nc c using (out_id, zoneid)",
    )
    q["zones_renumbered"] = query(TRIPS, ZONES, "select out_id, lat_e5, lon_e5, coalesce(sn, 9000+zoneid) zoneid from dict")
    q["zones_visit_centered"] = query(
        TRIPS, ZONES, SNAP,
        "select r_key, out_id, end_zoneid, sum(end_lat_e5) over w/count(*) over w/1e5 end_lat_adj, sum(end_lon_e5) over w/count(*) over w/1e5 end_lon_adj from snap window w as (partition by out_id, end_zoneid)",
    )
    q["car_top_centers"] = query(
        TRIPS, ZONES,
        "select out_id, " + ", ".join(f"max(center_lat) filter (sn={i}) center_lat_{i}, max(center_lon) filter (sn={i}) center_lon_{i}" for i in range(5)) + " from zlist group by out_id",
    )
    q["trip_center_distances"] = query(
        TRIPS, ZONES, SNAP, center_distances("snap", "cd", 4), "select r_key, out_id, dis_center_0, dis_center_1, dis_center_2, dis_center_3 from cd"
    )

    # cohorts
    q["cohort_quantile"] = query(TRIPS, ZONES, SNAP, QUANTILE, "select * from qcohort")
    q["cohort_geo"] = query(TRIPS, GEO, CELLS6, "select * from cohort6")
    q["cohort_holdout"] = query(
        TRIPS, ZONES, SNAP, QUANTILE,
        "select r_key, out_id, cohort, cast(case when row_number() over (partition by out_id order by r_key) <= count(*) over (partition by out_id)//5 then 1 else 0 end as bigint) holdout from trips join qcohort using (out_id)",
    )
    q["cohort_partitions"] = query(
        TRIPS, SPLIT, geo_of("labelled", "geo"), CELLS6,
        "select cohort, 'train' part, count(*) trips, count(distinct out_id) cars from labelled join cohort6 using (out_id) group by all union all select cohort, 'test', count(*), count(distinct out_id) from targets join cohort6 using (out_id) group by all",
    )
    q["holdout_latest"] = query(TRIPS, SPLIT, "select r_key, out_id, cast(case when newest <= n//5 then 1 else 0 end as bigint) holdout from ranked")
    q["holdout_earliest"] = query(
        TRIPS,
        "select r_key, out_id, cast(case when row_number() over (partition by out_id order by start_time, r_key) <= count(*) over (partition by out_id)*4//5 then 0 else 1 end as bigint) validate from trips",
    )
    models = (TRIPS, SPLIT, LZONES, EXAMPLES, MODELS)
    scores = (*models, SCORES)
    q["worst_cars"] = query(
        *scores, 'select b.out_id, b.loss, count(*) "count" from best b join targets t using (out_id) where b.loss >= 0.4 group by all having count(*) >= 5'
    )

    # features and models
    q["trip_features"] = query(
        TRIPS, FEATURE_TRIPS,
        " union all ".join(f"select out_id, r_key, '{c}' feature, {c}::double \"value\" from ft" for c in BASE),
    )
    q["features_scaled"] = query(
        TRIPS, SPLIT, f"lf as materialized (select *, {calendar_columns()} from labelled), tf as materialized (select *, {calendar_columns()} from targets)",
        deviations("lf", BASE, "out_id"),
        "select 'train' part, r_key, out_id, " + ", ".join(f"round(({c}-mean_{c})/std_{c}, 6) {c}" for c in BASE) + " from lf join dev using (out_id) union all select 'test', r_key, out_id, " + ", ".join(f"round(({c}-mean_{c})/std_{c}, 6)" for c in BASE) + " from tf join dev using (out_id)",
    )
    traffic = (
        geo_of("labelled", "lgeo"), geo_of("targets", "tgeo"),
        """pts as (select out_id, geo5 cell, 'out_' || cast((isodow(start_time)-1)*24+hour(start_time) as varchar) hour_wk from tgeo union all
        select out_id, geo5_end, 'in_' || cast((isodow(start_time)-1)*24+hour(start_time) as varchar) from lgeo union all
        select out_id, geo5, 'out_' || cast((isodow(start_time)-1)*24+hour(start_time) as varchar) from lgeo)""",
    )
    q["geo_hour_traffic"] = query(TRIPS, SPLIT, *traffic, "select cell, hour_wk, count(*) trips, count(distinct out_id) cars from pts group by all")
    q["geo_hour_matrix"] = query(
        TRIPS, SPLIT, *traffic,
        "select cell, " + ", ".join(f"count(*) filter (hour_wk='{w}_{h}') {w}_{h}" for w in ("in", "out") for h in range(168)) + " from pts group by cell",
    )
    q["geo_hour_gram"] = query(
        TRIPS, SPLIT, *traffic, "hours as (select cell, hour_wk, count(*) n from pts group by all)",
        "select a.hour_wk hour_a, b.hour_wk hour_b, cast(sum(a.n*b.n) as bigint) product from hours a join hours b on a.cell = b.cell and a.hour_wk <= b.hour_wk group by all",
    )
    cell = lambda side: (f"(({side}_lon_e5+18000000)*{2**15})//36000000", f"(({side}_lat_e5+9000000)*{2**15})//18000000")
    lx, ly = cell("start")
    q["train_near_targets"] = query(
        TRIPS, SPLIT,
        f"tc as (select distinct out_id, {lx} x, {ly} y from targets)",
        f"lc as (select r_key, out_id, {lx} x, {ly} y from labelled)",
        "fl as (select r_key, out_id, exists(select 1 from tc where tc.out_id=lc.out_id and abs(tc.x-lc.x)<=1 and abs(tc.y-lc.y)<=1) near from lc)",
        "select r_key, out_id from fl qualify near or not max(near) over (partition by out_id)",
    )
    q["train_top_zones"] = query(
        TRIPS, ZONES, SNAP,
        "tz as (select out_id, end_zoneid from snap group by out_id, end_zoneid qualify row_number() over (partition by out_id order by count(*) desc, end_zoneid) <= 10)",
        "select r_key, out_id, end_zoneid from snap join tz using (out_id, end_zoneid)",
    )
    q["tree_best_split"] = query(
        TRIPS, ZONES, SNAP, TREE,
        "select out_id, feature, cast(v+nv as bigint) twice_cut, cast(w as bigint) weight, round(score - cast(s as double)/w, 6) gain from scoredcuts qualify row_number() over (partition by out_id order by score desc, feature, v)=1",
    )
    boost = boosted(rounds=2, depth=4)
    q["boosted_probabilities"] = query(
        *models[:-1], boost,
        "last as (select *, exp(m - max(m) over (partition by fold, out_id, r_key)) e from bm2 semi join queries using (fold, out_id, r_key))",
        "select fold, out_id, r_key, zone zoneid, round(e / sum(e) over (partition by fold, out_id, r_key), 6) p from last",
    )
    q["knn_probabilities"] = query(*models, "select fold, out_id, r_key, zoneid, p from probs where model='m0'")
    examples = (TRIPS, SPLIT, LZONES, EXAMPLES)
    plain_rows = f"""
tt as materialized (select *, row_number() over () from (select out_id, r_key, {calendar_columns()}, coalesce(start_zoneid, 0) start_zoneid, end_zoneid from snap)),
t_rows as (select out_id, r_key, end_zoneid label from tt), t_asked as (select out_id, r_key from tt),
t_x as materialized ({long_features('tt', _tree_features, 'out_id')}), t_size as (select distinct out_id, 4 n_features from tt)"""
    tree = (TRIPS, ZONES, SNAP, plain_rows, forest_sql("t", 1, 4))
    q["tree_probabilities"] = query(*tree, "select out_id, r_key, zoneid, p from t_each")
    gains = " union all ".join(f"select feature, score - cast(s as double)/w gain from t_splits{i}" for i in range(4))
    names = ", ".join(f"({i}, '{c}')" for c, i in _tree_features.items())
    q["feature_importance"] = query(
        *tree, f"gains as ({gains})",
        f"select name, round(coalesce(sum(gain), 0)/(select sum(gain) from gains), 6) importance from (values {names}) n(feature, name) left join gains using (feature) group by name",
    )
    q["forest_probabilities"] = query(
        *examples,
        f"f_rows as (select fold, out_id, r_key, end_zoneid label from train), f_asked as (select fold, out_id, r_key from queries), f_size as (select distinct fold, out_id, {len(BASE)} n_features from train),"
        f" f_all as (select fold, out_id, r_key, {', '.join(BASE)} from train union all select fold, out_id, r_key, {', '.join(BASE)} from queries),"
        f" f_x as materialized ({long_features('f_all', BASE, 'fold, out_id')})",
        forest_sql("f", 100, 4, POISSON, True, "fold, out_id"),
        mean_of_trees("f", "fold, out_id"),
    )
    final_rows = (
        "o_train as (select * from train where fold = 'final'), o_query as (select * from queries where fold = 'final'),"
        f" o_rows as (select out_id, r_key, end_zoneid label from o_train), o_size as (select distinct out_id, {len(BASE)} n_features from o_train),"
        f" o_all as (select out_id, r_key, {', '.join(BASE)} from o_train union select out_id, r_key, {', '.join(BASE)} from o_query),"
        f" o_x as materialized ({long_features('o_all', BASE, 'out_id')})"
    )
    folds = forest_sql("o", 5, 4, f"(case when {FOLD} <> tree then 1 else 0 end)")
    q["out_of_fold_probabilities"] = query(
        *examples, final_rows, "o_asked as (select out_id, r_key from o_rows)", folds,
        f"select out_id, cast(tree as integer) part, r_key, zoneid, round(p, 6) p from o_each where tree = {FOLD}",
    )
    q["fold_average"] = query(
        *examples, final_rows, "o_asked as (select out_id, r_key from o_query)", folds,
        "select out_id, r_key, zoneid, round(avg(p), 6) p from o_each group by all",
    )
    stack = (
        *models,
        "s_named as (select *, model || '#' || zoneid feature_name from probs),"
        " s_places as materialized (select out_id, feature_name, row_number() over (partition by out_id order by feature_name) - 1 feature from (select distinct out_id, feature_name from s_named where fold = 'validate')),"
        " s_size as (select out_id, count(*) n_features from s_places group by all),"
        " s_rows as (select distinct out_id, r_key, k.end_zoneid label from s_named n join known k using (out_id, r_key) where fold = 'validate'),"
        " s_asked as (select distinct out_id, r_key from s_named join s_places using (out_id, feature_name) where fold = 'final'),"
        " s_all as (select out_id, r_key from s_rows union select out_id, r_key from s_asked),"
        " s_x as materialized (select out_id, r_key, feature, coalesce(cast(round_even(p*100, 0) as bigint), 0) v from s_all join s_places using (out_id)"
        "  left join s_named using (out_id, r_key, feature_name))",
        forest_sql("s", 100, 4, POISSON, True),
    )
    q["stacked_probabilities"] = query(*stack, mean_of_trees("s", "out_id"))
    q["stacked_position"] = query(
        *stack, f"s_mean as ({mean_of_trees('s', 'out_id')})",
        "s_best as (select out_id, r_key, zoneid from s_mean qualify row_number() over (partition by out_id, r_key order by p desc, zoneid) = 1)",
        "s_first as (select out_id, zoneid, min((lat_e5, lon_e5)) a from dict group by all)",
        "select r_key, b.out_id, zoneid predict_zone_id, a[1]/1e5 predict_lat, a[2]/1e5 predict_lon from s_best b left join s_first using (out_id, zoneid)",
    )
    q["knn_weighted"] = query(
        *models,
        "weighed as (select *, case when min(far) over (partition by fold, out_id, r_key) = 0 then (far = 0)::int::double else 1/sqrt(far) end w from k1_near)",
        "select fold, out_id, r_key, zoneid, round(sum(w)/sum(sum(w)) over (partition by fold, out_id, r_key), 6) p from weighed group by fold, out_id, r_key, zoneid having sum(w) > 0",
    )
    q["runs_any_form"] = query(
        *scores,
        "firsts as (select out_id, zoneid, min((lat_e5, lon_e5)) a from dict group by all)",
        "select model, r_key, predict_lat, predict_lon from preds where fold='final' and model='m1' union all"
        " select model, k.r_key, a[1]/1e5, a[2]/1e5 from picked k join firsts z on k.out_id=z.out_id and k.predict_zone_id=z.zoneid where fold='final' and model='m0'",
    )
    q["predicted_zone"] = query(*scores, "select model, fold, r_key, out_id, predict_zone_id, p from picked")
    q["predicted_position"] = query(*scores, "select model, fold, r_key, out_id, predict_zone_id, predict_lat, predict_lon from preds")
    q["two_pass_predictions"] = query(
        *scores,
        "select p.fold, p.r_key, p.out_id, predict_zone_id, predict_lat, predict_lon, 'knn' model_type, 500 threshold, 'k=19,p=5' kw, round(s.loss_e5/1e5, 5) final_loss from preds p left join (select r_key, loss_e5 from scored where model='m0') s using (r_key) where p.model='m0'",
    )
    q["threshold_sweep"] = query(TRIPS, SPLIT, SWEEP, "select * from swept")
    q["sweep_best"] = query(
        TRIPS, SPLIT, SWEEP, "select cohort, run_id, loss from swept qualify row_number() over (partition by cohort order by loss, run_id)=1"
    )

    # evaluation
    q["miss_distance"] = query(*scores, "select model, r_key, cast(round_even(loss_dis, 0) as bigint) loss_dis from scored")
    q["trip_loss"] = query(*scores, "select model, r_key, loss_e5/1e5 final_loss from scored")
    q["loss_accuracy"] = query(
        *scores,
        f"select model, count(*) trips, {half_even('sum(loss_e5)', 'count(*)')}/1e5 loss, {half_even('10000*sum(case when end_zoneid=predict_zone_id then 1 else 0 end)', 'count(*)')}/1e4 accuracy from scored group by all",
    )
    q["loss_by_car"] = query(*scores, "select * from carloss")
    q["multilabel_f"] = query(
        LABEL_ROWS,
        "ml as (select doc_id r_key, quality truth, score >= 0.5 p from lab union all select doc_id, toxic, (1-score) >= 0.5 from lab)",
        "sm as (select r_key, cast(sum(case when p then truth else 0 end) as bigint) correct_sum, cast(sum(truth) as bigint) true_sum, cast(sum(case when p then 1 else 0 end) as bigint) pred_sum from ml group by all)",
        "select *, coalesce(2*correct_sum/nullif(true_sum+pred_sum, 0), 0) f_measure from sm",
    )
    q["precision_recall_f"] = query(
        LABEL_ROWS,
        "sm as (select sum(round_even(quality*score,0)) tp, sum(round_even(score,0)) pp, sum(quality) ap from lab)",
        "pr as (select tp/(pp+1e-7) p, tp/(ap+1e-7) r from sm)",
        "select round(p, 9) \"precision\", round(r, 9) recall, round(5*(p*r)/(4*p+r+1e-7), 9) fbeta, round(2*(p*r)/(p+r+1e-7), 9) f1 from pr",
    )
    q["best_cutoff"] = query(
        LABEL_ROWS,
        "cutoffs as (select unnest([10,15,20,25,30,35,40,45,50,55]) c)",
        "cf as (select c, sum(case when score > c/100 then quality else 0 end) tp, sum(case when score > c/100 then 1 else 0 end) pp, sum(quality) ap from lab, cutoffs group by c)",
        f"ff as (select c/100 threshold, {half_even('200000*tp', '(pp+ap)')}/1e5 f1 from cf)",
        "select threshold, f1 from ff order by f1 desc, threshold limit 1",
    )

    # ensembles
    q["best_model_by_car"] = query(*scores, "select * from best")
    q["mean_best_loss"] = query(*scores, "select round(avg(loss), 6) loss, count(*) cars from best")
    q["merged_predictions"] = query(*scores, "select p.model, p.r_key, p.out_id, predict_zone_id, predict_lat, predict_lon from preds p join best b using (out_id, model) where fold='final'")
    q["submission"] = query(
        *scores,
        "mp as (select p.* from preds p join best b using (out_id, model) where fold='final')",
        "select t.r_key, predict_lat end_lat, predict_lon end_lon from targets t left join mp using (r_key)",
    )
    q["coalesced_predictions"] = query(
        *scores,
        geo_of("labelled", "geo"), CELLS6,
        "a as (select p.* from preds p join cohort6 using (out_id) where fold='final' and model='m1'), b as (select * from preds where fold='final' and model='m0')",
        "select b.r_key, coalesce(a.predict_lat, b.predict_lat) predict_lat, coalesce(a.predict_lon, b.predict_lon) predict_lon from b left join a using (r_key)",
    )
    q["concatenated_predictions"] = query(*scores, "select model, r_key, predict_lat, predict_lon from preds where fold='final' and model in ('m0','m1')")
    q["stack_features"] = query(*models, "select fold, out_id, r_key, model || '#' || zoneid feature, p from probs")

    # quality
    q["impute_missing"] = query(
        EVENTS_HOLED,
        "fills as (select coalesce((select avg(v) from holed where tr=1 and not isinf(v)), 0) m, (select t from holed where tr=1 and t is not null group by t order by count(*) desc, t limit 1) c)",
        "select event_id, round(case when v is null or isinf(v) then m else v end, 6) v, coalesce(t, c) t, coalesce(r, 'null') r from holed, fills",
    )
    q["label_encode"] = query(
        "d as (select doc_id, case when doc_id%11=0 then 'Other' else lang end lang, source from documents)",
        "select doc_id, dense_rank() over (order by lang)-1 lang, dense_rank() over (order by source)-1 source from d",
    )
    q["numeric_exceptions"] = query(
        EVENTS_HOLED,
        "select 'v' \"column\", cast(sum(case when v is null or isnan(v) then 1 else 0 end) as bigint) missing, cast(sum(case when isinf(v) then 1 else 0 end) as bigint) infinite from holed union all select 'event_id', 0, 0",
    )
    q["exception_report"] = query(EVENTS_HOLED, "select event_id, v from holed where v is null or isinf(v)")
    return q
