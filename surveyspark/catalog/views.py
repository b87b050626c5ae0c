"""The same survey views for the SQL side."""

VIEWS = {
    "px": """select * exclude (m), (m < 7) as ocean, (m >= 9) as land, (m >= 7 and m < 9) as waves from (
        select frame, label, y, x, raw, cast(100 + frame % 8 as int) as media,
          (raw*7 + x*13) % 256 as r, (raw*11 + y*17) % 256 as g, (raw*3 + x*y*5) % 256 as b,
          (frame*31 + y*7 + x*3) % 10 as m
        from (select vec_id as frame, label, pos // 8 as y, pos % 8 as x,
                2950 + cast(floor(cast(embedding[pos+1] as double) * 100) as int) as raw
              from embeddings, (select unnest(range(64)) as pos)))""",
    "hist": "select frame, media, raw, count(*) as n from px where ocean group by all",
    "ocean_frames": "select frame, media, row_number() over (partition by media order by frame) - 1 as idx "
    "from (select distinct frame, media from px where ocean)",
    "med": "select frame, media, quantile_cont(raw, 0.5) as m, quantile_cont(raw, 0.25) as q25, "
    "quantile_cont(raw, 0.75) as q75, count(*) as n from px where ocean group by all",
    "cold": "select p.frame, p.media, p.y, p.x, p.raw, m.m from px p join med m using (frame) "
    "where p.ocean and p.raw < m.m - 5",
    "captures": """select event_id as frame, user_id as flight, ts, event_type, value, props,
        -27.15e0 + (event_id % 20) * 0.0005e0 + ((event_id * 7919) % 101) * 0.000001e0 as lat,
        -109.44e0 + ((event_id // 20) % 20) * 0.0005e0 + ((event_id * 104729) % 103) * 0.000001e0 as lon,
        380 + event_id % 40 as altitude, (event_id * 37) % 360 as heading, event_id % 400 as site
        from events""",
    "dets": """select *, value as area_m2, -(0.5e0 + value/100) as anomaly, (1 + frame % 5) * 0.00001e0 as half
        from captures where event_type = 'purchase'""",
    "boxes": """select frame, area_m2, lon-half as min_lon, lon+half as max_lon, lat-half as min_lat,
        lat+half as max_lat from dets""",
    "thr": "select unnest([0.5e0, 1.0e0, 1.5e0, 2.0e0]) as threshold",    "wide": """select frame // 64 as frame, (frame % 64) // 8 * 8 + y as y, frame % 8 * 8 + x as x, raw, frame % 64 = 0 and land as land from px""",
    "wide_shore": """select distinct o.frame, o.y, o.x from wide o join wide l on l.frame = o.frame and l.land and not o.land
        and (o.y-l.y)*(o.y-l.y) + (o.x-l.x)*(o.x-l.x) <= 4""",
    "wide_dist": """select p.frame, p.y, p.x, p.raw, p.land, sqrt(min((p.y-s.y)*(p.y-s.y) + (p.x-s.x)*(p.x-s.x))) as d
        from wide p left join wide_shore s using (frame) group by all""",
    "wide_med": "select frame, quantile_cont(raw, 0.5) as m from wide where not land group by frame",
}


def components(name: str, mask: str, conn: int = 8, keys: str = "frame") -> dict[str, str]:
    """CTEs labelling the regions of ``mask`` (keys, y, x): (keys, y, x, region)."""
    ks = [k.strip() for k in keys.split(",")]
    on = " and ".join(f"m.{k} = r.{k}" for k in ks)
    rk = ", ".join(f"r.{k}" for k in ks)
    near = "greatest(abs(m.y - r.y), abs(m.x - r.x)) <= 1" if conn == 8 else "abs(m.y - r.y) + abs(m.x - r.x) <= 1"
    return {
        f"{name}_m": f"select distinct {keys}, y, x from ({mask})",
        f"{name}_r": f"""select {keys}, y, x, y*8+x as root from {name}_m union
            select {rk}, m.y, m.x, r.root from {name}_r r join {name}_m m on {on} and {near}""",
        name: f"select {keys}, y, x, min(root) as region from {name}_r group by {keys}, y, x",
    }


def offsets(r: int) -> str:
    cells = [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r]
    return "(values " + ", ".join(f"({a},{b})" for a, b in cells) + ") o(dy, dx)"


def dilated(mask: str, r: int) -> str:
    return (
        f"select distinct frame, y + dy as y, x + dx as x from ({mask}), {offsets(r)} "
        "where y + dy between 0 and 7 and x + dx between 0 and 7"
    )


def eroded(mask: str, r: int) -> str:
    """Outside counts as false."""
    n = offsets(r).count("(") - 2
    return (
        f"select frame, y + dy as y, x + dx as x from ({mask}), {offsets(r)} "
        f"where y + dy between 0 and 7 and x + dx between 0 and 7 group by all having count(*) = {n}"
    )


def eroded_open_border(mask: str, r: int) -> str:
    """Outside counts as true."""
    outside = f"select frame, y, x from px except select frame, y, x from ({mask})"
    return f"select frame, y, x from ({mask}) except {dilated(outside, r)}"


def large(name: str, mask: str, n: int) -> dict[str, str]:
    """CTEs keeping the pixels of 4-connected regions of at least ``n``: those that reach as many within n - 1 steps."""
    four = "(values (0,0), (0,1), (0,-1), (1,0), (-1,0)) o(dy, dx)"
    ctes = {f"{name}_m": f"select distinct frame, y, x from ({mask})", f"{name}_0": f"select frame, y, x, y as v, x as u from {name}_m"}
    for i in range(1, n):
        ctes[f"{name}_{i}"] = f"select distinct s.frame, s.y, s.x, m.y as v, m.x as u from {name}_{i - 1} s cross join {four} join {name}_m m on m.frame = s.frame and m.y = s.v + dy and m.x = s.u + dx"
    return ctes | {name: f"select frame, y, x from {name}_{n - 1} group by frame, y, x having count(*) >= {n}"}


def filled(name: str, mask: str, n: int) -> dict[str, str]:
    """CTEs adding 4-connected background regions below ``n``."""
    back = large(f"{name}_b", f"select frame, y, x from px except select frame, y, x from ({mask})", n)
    return back | {name: f"select frame, y, x from px except select * from {name}_b"}


def smoothed(name: str, mask: str, n: int) -> dict[str, str]:
    """CTEs dropping specks and holes below ``n``, closing by a disk of 2 and opening by a disk of 1."""
    return {
        **large(f"{name}_k", mask, n), **filled(f"{name}_f", f"select * from {name}_k", n), f"{name}_d": dilated(f"select * from {name}_f", 2),
        f"{name}_c": eroded_open_border(f"select * from {name}_d", 2), f"{name}_e": eroded_open_border(f"select * from {name}_c", 1), name: dilated(f"select * from {name}_e", 1),
    }


def masks_of(ctes: dict[str, str], ocean: str, land: str, waves: str) -> str:
    """The statement that lists every pixel with its membership in three masks."""
    has = lambda m, n: f"(frame, y, x) in (select (frame, y, x) from ({m})) as {n}"
    body = f"select frame, y, x, {has(ocean, 'ocean')}, {has(land, 'land')}, {has(waves, 'waves')} from px"
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in ctes.items()) + " " + body


PXALL = "select frame, y, x from px"
OCEAN = "select frame, y, x from px where ocean"
LAND = "select frame, y, x from px where land"
WAVES = "select frame, y, x from px where waves"
COLD = "select frame, y, x from cold"

VIEWS["shore"] = f"(select * from ({dilated(LAND, 2)}) intersect {OCEAN}) union {WAVES}"
VIEWS["dist"] = """select p.frame, p.y, p.x, sqrt(min((p.y-s.y)*(p.y-s.y) + (p.x-s.x)*(p.x-s.x))) as d
    from px p join shore s using (frame) group by all"""
VIEWS.update(components("ocean8", OCEAN))
VIEWS.update(components("cold8", COLD))
VIEWS.update(components("land4", LAND, 4))

PROPS = """area, cy, cx, min_y, min_x, max_y, max_x,
  sqrt(greatest(1 - (vx+vy-sqrt((vx-vy)*(vx-vy)+4*vxy*vxy))/(vx+vy+sqrt((vx-vy)*(vx-vy)+4*vxy*vxy)), 0)) as eccentricity"""
MOMENTS = """count(*) as area, avg(y) as cy, avg(x) as cx, min(y) as min_y, min(x) as min_x, max(y)+1 as max_y, max(x)+1 as max_x,
  sum(y*y)::double/count(*) - pow(sum(y)::double/count(*),2) + 1/12e0 as vy, sum(x*x)::double/count(*) - pow(sum(x)::double/count(*),2) + 1/12e0 as vx,
  sum(x*y)::double/count(*) - sum(x)::double/count(*)*(sum(y)::double/count(*)) as vxy"""


def plumes(cold: str, name: str, keys: str = "frame") -> dict[str, str]:
    """CTEs measuring the regions of ``cold`` (keys, y, x, raw, m): one row per region."""
    ks = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    using = keys + ", y, x"
    return {
        f"{name}_c": cold,
        **components(f"{name}_l", f"select {keys}, y, x from {name}_c", 8, keys),
        name: f"""select *, {PROPS.split(',', 7)[7]}, mean_raw/10 - 273.15 as mean_temp, (mean_raw - base)/10 as anomaly from (
            select {ks}, l.region, {MOMENTS.replace('(y', '(c.y').replace('(x', '(c.x').replace('*y', '*c.y').replace('*x', '*c.x')},
              avg(c.raw) as mean_raw, min(c.raw)/10-273.15 as min_temp, max(c.raw)/10-273.15 as max_temp, any_value(c.m) as base, min(d.d) as min_shore, avg(d.d) as mean_shore,
              max(c.y = 0) as t_top, max(c.y = 7) as t_bottom, max(c.x = 0) as t_left, max(c.x = 7) as t_right
            from {name}_c c join {name}_l l using ({using}) join dist d on d.frame = c.frame and d.y = c.y and d.x = c.x
            group by {ks}, l.region)""",
    }


VIEWS.update(plumes("select frame, y, x, raw, m from cold", "plume"))
VIEWS["moving"] = """select f.media, f.frame, quantile_cont(h.raw, 0.5) as m
    from ocean_frames f join ocean_frames g on g.media = f.media and g.idx between f.idx - 4 and f.idx
    join px h on h.frame = g.frame and h.ocean group by all"""
VIEWS.update(
    plumes("select p.frame, p.y, p.x, p.raw, v.m from px p join moving v using (frame) where p.ocean and p.raw < v.m - 5", "plume_mv")
)
VIEWS.update(
    plumes(
        "select threshold, p.frame, p.y, p.x, p.raw, v.m from px p join med v using (frame), thr where p.ocean and p.raw < v.m - 10*threshold",
        "plume_t",
        "threshold, frame",
    )
)
