"""DuckDB twins of the queries."""

from __future__ import annotations

import json

from .. import constants as K
from ..functions.pixels import BLUE, GREEN, RED
from ..operators.responses import RequestText, response_schema
from . import fixtures as fx
from .queries import PROVIDERS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _listed(values) -> str:
    return ", ".join(_text(v) for v in values)


NORM = f"""
det as ({fx.DETECTIONS_SQL}),
norm as (select det_id, pos, scene_id, task_idx, coalesce(category, 'other') as category,
  case when change_type in ({_listed(K.CHANGE_TYPES)}) then change_type else 'modified' end as change_type,
  description, case when confidence in ({_listed(K.CONFIDENCES)}) then confidence else 'medium' end as confidence,
  x, y, w, h from det)"""

RANK = "case confidence when 'high' then 2 when 'medium' then 1 else 0 end"


def iou_sql(a: str, b: str) -> str:
    across = f"greatest(0, least({a}x + {a}w, {b}x + {b}w) - greatest({a}x, {b}x))"
    down = f"greatest(0, least({a}y + {a}h, {b}y + {b}h) - greatest({a}y, {b}y))"
    inter = f"({across} * {down})"
    union = f"({a}w * {a}h + {b}w * {b}h - {inter})"
    return f"(case when {union} <= 0 then 0 else {inter} / {union} end)"


def merged_sql(source: str) -> str:
    """CTEs ending in ``merged``: the rows of ``source`` kept by the sequential visit, with n and id."""
    return f"""
ordered as (select *, row_number() over (partition by scene_id, change_type
    order by {RANK} desc, w * h desc, task_idx, pos) as rn from {source}),
walk as (
  select scene_id, change_type, rn, [{{'task_idx': task_idx, 'pos': pos, 'x': x, 'y': y, 'w': w, 'h': h}}] as kept
  from ordered where rn = 1
  union all
  select o.scene_id, o.change_type, o.rn,
    case when len(list_filter(t.kept, lambda k: {iou_sql('k.', 'o.')} > 0.4e0)) > 0 then t.kept
      else list_append(t.kept, {{'task_idx': o.task_idx, 'pos': o.pos, 'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h}}) end
  from walk t join ordered o on o.scene_id = t.scene_id and o.change_type = t.change_type and o.rn = t.rn + 1),
ends as (select scene_id, change_type, unnest(arg_max(kept, rn)) as k from walk group by 1, 2),
merged as (select s.*, row_number() over (partition by s.scene_id order by s.y, s.x, {RANK} desc, s.w * s.h desc, s.task_idx, s.pos) as n
  from {source} s join ends e on s.scene_id = e.scene_id and s.task_idx = e.k.task_idx and s.pos = e.k.pos)"""


MERGED = f"with recursive {NORM}, {merged_sql('norm')}"
VISIBLE = ("change_type in ('added', 'removed') and confidence in ('medium', 'high')"
           " and contains(lower(description || ' ' || category), 'roof_a 50%')")

SCENES = f"scenes as ({fx.SCENES_SQL})"


def _shrunk(extent: str, bound: int) -> str:
    return f"cast(floor({extent} * least(1.0e0, {bound}.0e0 / greatest(width, height)) + 0.5e0) as bigint)"


FRAMES = f"""{SCENES},
frames as (select scene_id, width, height, {_shrunk('width', 2600)} as work_w, {_shrunk('height', 2600)} as work_h from scenes)"""


def tiles_sql(source: str, tile_px: int) -> str:
    """CTE ``tiles``; valid where the cap on tiles does not bind."""
    return f"""
grid as (select *, cast(greatest(1, ceil(work_w / {tile_px}.0e0)) as bigint) as c,
    cast(greatest(1, ceil(work_h / {tile_px}.0e0)) as bigint) as r from {source}),
cells as (select *, unnest(range(c * r)) as i from grid),
spans as (select scene_id, work_w, work_h, i + 1 as task_idx,
    'r' || cast(i // c + 1 as varchar) || 'c' || cast(i % c + 1 as varchar) as label,
    greatest(0, floor((i % c) * (work_w / c) - (work_w / c) * 0.22e0)) as x0,
    greatest(0, floor((i // c) * (work_h / r) - (work_h / r) * 0.22e0)) as y0,
    least(work_w, ceil((i % c + 1) * (work_w / c) + (work_w / c) * 0.22e0)) as x1,
    least(work_h, ceil((i // c + 1) * (work_h / r) + (work_h / r) * 0.22e0)) as y1 from cells
  union all
  select scene_id, work_w, work_h, 0, 'overview', 0, 0, work_w, work_h from {source}),
sized as (select *, x1 - x0 as sw, y1 - y0 as sh, case when task_idx = 0 then 1500.0e0 else 1100.0e0 end as px from spans),
tiles as (select scene_id, task_idx, label, cast(x0 as bigint) as x0, cast(y0 as bigint) as y0,
    cast(sw as bigint) as sw, cast(sh as bigint) as sh,
    cast(greatest(1, floor(sw * least(1.0e0, px / greatest(sw, sh)) + 0.5e0)) as bigint) as out_w,
    cast(greatest(1, floor(sh * least(1.0e0, px / greatest(sw, sh)) + 0.5e0)) as bigint) as out_h,
    x0 / work_w as gx, y0 / work_h as gy, sw / work_w as gw, sh / work_h as gh from sized)"""


TILES = f"{FRAMES}, {tiles_sql('frames', 760)}"


def mapped_sql(box: str, tile: str = "t") -> str:
    """Expressions x, y, w, h of a box mapped from tile to scene."""
    x = f"least(greatest({tile}.gx + {box}.x * {tile}.gw, 0), 1)"
    y = f"least(greatest({tile}.gy + {box}.y * {tile}.gh, 0), 1)"
    return (f"{x} as x, {y} as y, least({box}.w * {tile}.gw, 1 - {x}) as w, least({box}.h * {tile}.gh, 1 - {y}) as h")


# --- responses: the shape says what parsing must find ------------------------------------

RESP = f"""
resp as ({fx.RESPONSES_SQL}),
parsed as (select *, error is not null or shape in (2, 3, 4, 6, 8, 11) as failed,
  coalesce(error, case when shape in (2, 3, 11) then 'Detector did not return valid JSON. Raw: ' || substr(raw_text, 1, 300)
    when shape = 4 then 'Response is null' when shape = 6 then 'Changes is not a list'
    when shape = 8 then 'Change entry is null' end) as failure,
  case when error is not null then '' when shape = 0 then 's' when shape = 1 then 'f' when shape = 7 then 'b'
    when shape = 10 then 'n' else '' end as summary,
  row_number() over (partition by scene_id order by event_id) - 1 as task_idx from resp),
truth(shape, pos, category, change_type, description, confidence, x, y, w, h) as (values
  (0, 0, 'road', 'added', 'd', 'high', 0.25e0, 0.25e0, 0.5e0, 0.5e0),
  (7, 0, 'house', null, null, null, 0.0e0, 0.0e0, 0.0e0, 0.0e0),
  (7, 1, 'plot', null, null, null, 0.5e0, 0.25e0, 0.0e0, 0.75e0),
  (9, 0, null, null, null, null, 0.0e0, 0.0e0, 0.0e0, 0.0e0),
  (9, 1, null, 'moved', null, 'sure', 0.0e0, 1.0e0, 1.0e0, 0.0e0)),
found as (select p.event_id, p.scene_id, p.task_idx, p.summary, p.model, t.* from parsed p join truth t using (shape) where not p.failed),
clean as (select event_id, scene_id, task_idx, pos, coalesce(category, 'other') as category,
  case when change_type in ({_listed(K.CHANGE_TYPES)}) then change_type else 'modified' end as change_type,
  coalesce(description, '') as description,
  case when confidence in ({_listed(K.CONFIDENCES)}) then confidence else 'medium' end as confidence, x, y, w, h from found)"""


def summary_sql(tasks: str, merged: str) -> str:
    """CTE ``run``: one summary row per scene."""
    return f"""
counts as (select scene_id, count(*) as n_changes from {merged} group by 1),
per as (select scene_id, count(*) as n_tasks, count(*) filter (failed) as n_failed,
  min(case when failed then task_idx end) as err_at,
  max(case when not failed and task_idx = 0 then summary end) as overview,
  min(case when not failed and model <> '' then task_idx end) as model_at from {tasks} group by 1),
run as (select p.scene_id, coalesce(n_changes, 0) as n_changes, n_tasks, n_failed,
  case when coalesce(overview, '') <> '' then overview else cast(coalesce(n_changes, 0) as varchar) || ' change' ||
    case when coalesce(n_changes, 0) = 1 then '' else 's' end || ' detected across ' || cast(n_tasks as varchar) || ' regions.' end as summary,
  coalesce(m.model, '') as model,
  case when n_failed > 0 then coalesce(nullif(e.failure, ''), 'unknown error') end as first_error,
  case when n_failed = 0 then 'none' when n_failed = n_tasks then 'all' else 'some' end as status
  from per p left join counts c on c.scene_id = p.scene_id
  left join {tasks} e on e.scene_id = p.scene_id and e.task_idx = p.err_at
  left join {tasks} m on m.scene_id = p.scene_id and m.task_idx = p.model_at)"""


RUN = f"with recursive {RESP}, {merged_sql('clean')}, {summary_sql('parsed', 'merged')}"

LABELS = "labels_dim(lang, key, template) as (values " + ", ".join(
    f"({_text(a)}, {_text(b)}, {_text(c)})" for a, b, c in K.LABELS) + ")"


def label_sql(lang: str, key: str) -> str:
    found = "(select template from labels_dim d where d.lang = {} and d.key = {})"
    return f"coalesce({found.format(lang, key)}, {found.format(_text('en'), key)}, {key})"


LANG = "case det_id % 3 when 0 then 'de' when 1 then 'en' else 'fr' end"

# --- request text ---------------------------------------------------------------------------

_wording = RequestText()


def _json(value) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def _request_sql() -> str:
    def image(kind: str, data: str) -> str:
        return (_text('{"type":"image","source":{"type":"base64","media_type":' + _json(kind) + ',"data":"')
                + f" || base64(encode({data})) || " + _text('"}}'))

    head = '{"model":"n-large","max_tokens":8000,"system":' + _json(_wording.system) + ',"messages":[{"role":"user","content":['
    tail = ']}],"output_config":' + _json({"format": {"type": "json_schema", "schema": response_schema()}}) + "}"

    def words(text: str) -> str:
        return _json({"type": "text", "text": text})

    closing = (f"case when lang = 'de' then {_text(words(_wording.instruction + _wording.language_suffix['de']))}"
               f" else {_text(words(_wording.instruction))} end")
    return (
        f"select doc_id, {_text(head + words(_wording.earlier_label) + ',')} || {image('image/png', 'text')} || "
        f"{_text(',' + words(_wording.later_label) + ',')} || {image('image/jpeg', 'reverse_points')} || ',' || {closing} || {_text(tail)} as request_json"
        " from (select *, array_to_string(list_reverse(string_split(text, '')), '') as reverse_points from documents)"
    )


# --- rasters ----------------------------------------------------------------------------------

CHECK = ("count(*) as n, sum(v) as total, sum(v * ((px * 31 + py * 17) % 97)) as placed")


def _pixel_check(sample: str, value: str = "v", where: str = "true") -> str:
    return (f"with pix as ({fx.pixels_sql(sample)}) select scene_id, band, {CHECK} from"
            f" (select scene_id, band, px, py, {value} as v from pix where {where}) group by 1, 2")


STRETCHED = ("case when isnan(v) then 0 else floor((v - lo) / (case when hi - lo = 0 then 1 else hi - lo end) * 255 + 0.5e0) end")


def _range_cte(where: str = "band < 3") -> str:
    return f"lim as (select scene_id, min(v) as lo, max(v) as hi from pix where {where} and not isnan(v) group by 1)"


def _warp_sql(w: int, h: int, sx: str, sy: str, sample: str = fx.U16_SAMPLE) -> str:
    """Bilinear sampling of the raster fixture at (sx, sy) for every pixel of a w x h frame."""
    taps = []
    for dy in (0, 1):
        for dx in (0, 1):
            wx = "(sx - fx)" if dx else "(1 - (sx - fx))"
            wy = "(sy - fy)" if dy else "(1 - (sy - fy))"
            taps.append(f"select scene_id, band, px, py, fx + {dx} as tx, fy + {dy} as ty, {wx} * {wy} as weight from spots")
    return f"""
with pix as ({fx.pixels_sql(sample)}),
outp as (select *, {sx} as sx, {sy} as sy from (select *, unnest(range({fx.RASTER_BANDS})) as band from
  (select *, unnest(range({h})) as py from (select s_suppkey as scene_id, unnest(range({w})) as px from supplier)))),
spots as (select *, floor(sx) as fx, floor(sy) as fy from outp),
taps as ({' union all '.join(taps)}),
summed as (select t.scene_id, t.band, t.px, t.py, floor(sum(t.weight * coalesce(p.v, 0)) + 0.5e0) as v
  from taps t left join pix p on p.scene_id = t.scene_id and p.band = t.band and p.px = t.tx and p.py = t.ty group by 1, 2, 3, 4)
select scene_id, band, {CHECK} from summed group by 1, 2"""


# --- registration -------------------------------------------------------------------------------

def _knn(odd: bool) -> str:
    return f"""{fx.keypoints_sql(odd)},
dist as (select q.scene_id, q.kp_id as q_id, t.kp_id as t_id, q.x as sx, q.y as sy, t.x as dx, t.y as dy,
  cast(bit_count(xor(q.d0, t.d0)) as bigint) + cast(bit_count(xor(q.d1, t.d1)) as bigint) as distance
  from later q join earlier t on q.scene_id = t.scene_id),
near as (select *, row_number() over (partition by scene_id, q_id order by distance, t_id) as k from dist),
ratio as (select a.* from near a join near b on a.scene_id = b.scene_id and a.q_id = b.q_id and a.k = 1 and b.k = 2
  where a.distance < 0.75e0 * b.distance),
gated as (select scene_id from later group by 1 having count(*) >= 8
  intersect select scene_id from earlier group by 1 having count(*) >= 8),
good as (select r.*, count(*) over (partition by scene_id) as match_count from ratio r where scene_id in (select scene_id from gated)
  qualify count(*) over (partition by scene_id) >= 12)"""


KNN, KNN_ODD = _knn(False), _knn(True)

_H = [f"cast({v!r} as double)" for v in fx.HOMOGRAPHY]
_depth = f"({_H[6]} * x + {_H[7]} * y + {_H[8]})"

# --- end to end ------------------------------------------------------------------------------------

_code = "(scene_id + task_idx)"
RUN_ALL = f"""with recursive {FRAMES.replace('from scenes)', "from scenes where epoch_mask = 3)")}, {tiles_sql('frames', 760)},
tasks as (select *, {_code} % 5 = 0 as failed, 'no answer ' || cast({_code} as varchar) as failure, '' as summary,
  'stub' as model from tiles),
local as (select scene_id, task_idx, 0 as pos, 'house' as category,
  case {_code} % 3 when 0 then 'added' when 1 then 'removed' else 'modified' end as change_type,
  'tile ' || cast(task_idx as varchar) as description, case {_code} % 2 when 0 then 'low' else 'medium' end as confidence,
  0.25e0 as x, 0.25e0 as y, 0.5e0 as w, 0.75e0 as h from tasks where not failed),
placed as (select l.scene_id, l.task_idx, l.pos, l.category, l.change_type, l.description, l.confidence, {mapped_sql('l')}
  from local l join tiles t on t.scene_id = l.scene_id and t.task_idx = l.task_idx),
{merged_sql('placed')}, {summary_sql('tasks', 'merged')}"""


def _providers_sql() -> str:
    rows = ", ".join(f"({_text(p)}, [{_listed(m)}], {_text(d)})" for p, m, d in PROVIDERS)
    return f"""dims(provider, models, default_model) as (values {rows}),
asked as (select event_id, case event_id % 4 when 0 then 'north' when 1 then 'south' when 2 then 'west' else null end as provider,
  case event_id % 5 when 0 then 'n-small' when 1 then 's-one' when 2 then null else 'other' end as model from events)"""


def _grid_sql() -> str:
    caps = ", ".join(f"max(case when cap = {c} then c end) as cols_{c}, max(case when cap = {c} then r end) as rows_{c}" for c in (1, 3, 7, 16))
    return f"""with recursive {FRAMES},
start as (select scene_id, work_w, work_h, cap, cast(greatest(1, ceil(work_w / 380.0e0)) as bigint) as c,
  cast(greatest(1, ceil(work_h / 380.0e0)) as bigint) as r from frames, (values (1), (3), (7), (16)) v(cap)),
steps as (select *, 0 as i from start union all
  select scene_id, work_w, work_h, cap, case when c >= r and c > 1 then c - 1 else c end,
    case when c >= r and c > 1 then r when r > 1 then r - 1 else r end, i + 1
  from steps where c * r > cap and (c > 1 or r > 1)),
last as (select * from steps qualify row_number() over (partition by scene_id, cap order by i desc) = 1)
select scene_id, work_w, work_h, {caps} from last group by 1, 2, 3"""


POINTS = """pts as (select det_id, scene_id, (det_id * 5 % 64 + 0.5e0) / 64 as px, (det_id * 3 % 64 + 0.5e0) / 64 as py from det),
spot as (select * from norm where confidence in ('medium', 'high') and contains(lower(description || ' ' || category), 'roof_a 50%'))"""
LIT = ("exists (select 1 from spot s where s.scene_id = p.scene_id and p.px >= s.x and p.px < s.x + s.w"
       " and p.py >= s.y and p.py < s.y + s.h)")

IMAGES = f"""{SCENES},
imgs as (select scene_id, 'earlier' as epoch, width, height from scenes where epoch_mask in (1, 3)
  union all select scene_id, 'later', width + 64, height from scenes where epoch_mask in (2, 3))"""

WRAPPED = "cast(floor(event_id / 12) as bigint) % 2 = 0"
TILE_SELECT = "select scene_id, task_idx, label, x0, y0, sw, sh, out_w, out_h, gx, gy, gw, gh from tiles"
HEADING_LANG = "case when scene_id % 2 = 0 then 'de' else 'en' end"
KEY4 = "case when det_id % 5 = 0 then 'report.' || category else 'cat.' || category end"


def _under(x: str, y: str) -> str:
    """Columns hx, hy: a point under the homography of the keypoint fixture."""
    n = [f"cast({v!r} as double)" for v in fx.HOMOGRAPHY]
    depth = f"({n[6]} * {x} + {n[7]} * {y} + {n[8]})"
    return f"({n[0]} * {x} + {n[1]} * {y} + {n[2]}) / {depth} as hx, ({n[3]} * {x} + {n[4]} * {y} + {n[5]}) / {depth} as hy"


ORACLES: dict[str, str] = {
    "s1_scan_gate": f"""select page_id, path, ext from (select *, lower(regexp_extract(path, '[^.]*$')) as ext from
        (select page_id, url || case page_id % 6 when 0 then '.PNG' when 1 then '.jpeg' when 2 then '.html' when 3 then ''
          when 4 then '.tar.TIFF' else '.webp' end as path from pages)) where ext in ({_listed(K.IMAGE_EXTENSIONS)})""",
    "s3_size_guard": f"""with {SCENES} select scene_id, byte_len, case when byte_len is null then 'missing'
        when byte_len > 157286400 then 'size ' || cast(byte_len as varchar) || ' exceeds 157286400 bytes' end as reject_reason from scenes""",
    "s4_pair_scenes": f"""with {IMAGES} select e.scene_id, e.width as ref_w, e.height as ref_h, l.width as tgt_w, l.height as tgt_h
        from imgs e join imgs l on e.scene_id = l.scene_id and e.epoch = 'earlier' and l.epoch = 'later'""",
    "j9_unpaired_scenes": f"""with {IMAGES} select scene_id, epoch from imgs a
        where not exists (select 1 from imgs b where b.scene_id = a.scene_id and b.epoch <> a.epoch)""",
    "s5_parse_data_url": """select doc_id, case doc_id % 4 when 0 then 'image/png' when 1 then 'image/svg+xml' end as media_type,
        case when doc_id % 4 < 2 then text end as data, doc_id % 4 < 2 as valid from documents""",
    "s6_to_data_url": "select doc_id, 'data:image/png;base64,' || base64(encode(text)) as url from documents",
    "s7_validate_requests": """select doc_id, case when doc_id % 5 = 0 or doc_id % 7 = 0 then 'reference and target are required' end as reject_reason
        from documents""",
    "n8_resolve_model": f"""with {_providers_sql()} select event_id, a.provider, a.model, coalesce(d.provider, 'north') as resolved_provider,
        case when list_contains(coalesce(d.models, f.models), a.model) then a.model else coalesce(d.default_model, f.default_model) end as resolved_model
        from asked a left join dims d on d.provider = a.provider left join dims f on f.provider = 'north'""",
    "n8_resolve_model_strict": f"""with {_providers_sql()} select event_id, a.provider, a.model, a.provider as resolved_provider,
        case when list_contains(d.models, a.model) then a.model else d.default_model end as resolved_model,
        case when d.provider is null then 'no such provider: ' || coalesce(a.provider, 'null') end as provider_error
        from asked a left join dims d on d.provider = a.provider""",
    "s8_build_requests": _request_sql(),
    "s9_report_rows": f"""{MERGED}, {LABELS} select scene_id, n, 'chg-' || cast(n as varchar) as id,
        {label_sql("'de'", "('type.' || change_type)")} as type_label,
        case when {label_sql("'de'", "('cat.' || category)")} = 'cat.' || category then category else {label_sql("'de'", "('cat.' || category)")} end as category_label,
        description, case confidence when 'low' then '35%' when 'medium' then '65%' else '90%' end as confidence_label, x, y, w, h from merged""",
    "s10_failed_tasks": f"with {RESP} select event_id, scene_id, failure from parsed where failed",
    "g1_working_frame": f"""with {FRAMES} select f.scene_id, f.width, f.height, {_shrunk('width', 1536)} as small_w,
        {_shrunk('height', 1536)} as small_h, work_w, work_h from frames f""",
    "g2_fit_inside": f"""with {SCENES} select scene_id, width, height, greatest(1, {_shrunk('width', 3000)}) as fit_w,
        greatest(1, {_shrunk('height', 3000)}) as fit_h from scenes""",
    "g3_plan_grid": _grid_sql(),
    "g4_explode_tiles": f"with {TILES} {TILE_SELECT} where task_idx > 0",
    "g5_overview_tile": f"with {TILES} {TILE_SELECT} where task_idx = 0",
    "g6_crop_size": f"""with {SCENES} select scene_id,
        cast(greatest(1, floor(width * least(1.0e0, 1100.0e0 / greatest(width, height)) + 0.5e0)) as bigint) as out_w,
        cast(greatest(1, floor(height * least(1.0e0, 1100.0e0 / greatest(width, height)) + 0.5e0)) as bigint) as out_h from scenes""",
    "u1_ordered_tasks": f"""with {TILES} select scene_id, count(*) as n_tasks, arg_min(label, task_idx) as first_label,
        arg_max(label, task_idx) as last_label from tiles group by 1""",
    "g8_map_to_global": f"""with {NORM}, {TILES}, sizes as (select scene_id, count(*) as n_tasks from tiles group by 1),
        placed as (select d.* replace (d.scene_id % (select count(*) from part) as scene_id) from det d),
        asked as (select p.* replace (p.det_id % s.n_tasks as task_idx) from placed p join sizes s on s.scene_id = p.scene_id)
        select d.det_id, d.scene_id, cast(d.task_idx as bigint) as task_idx, {mapped_sql('d')}
        from asked d join tiles t on t.scene_id = d.scene_id and t.task_idx = d.task_idx""",
    "g9_box_area": f"with {NORM} select det_id, w * h as area from det",
    "g10_iou": f"""with {NORM}, two as (select det_id, {{'x': x, 'y': y, 'w': w, 'h': h}} as a, {{'x': y, 'y': x, 'w': h, 'h': w}} as b from det)
        select det_id, {iou_sql('a.', 'b.')} as iou from two""",
    "g11_rescale_boxes": f"""with {NORM}, sized as (select det_id, 400 + (det_id * 37) % 6000 as width,
          (det_id % 11) * (300 + (det_id * 53) % 5000) as height, x, y, w, h from det),
        drawn as (select *, floor(1000.0e0 / (case when width > 0 and height > 0 then width / height else 1.0e0 end) + 0.5e0) as rows_px from sized)
        select det_id, width, height, x, y, w, h, x * 1000 as px_x, y * rows_px as px_y, w * 1000 as px_w, h * rows_px as px_h,
          x * 100 as pct_x, y * 100 as pct_y, w * 100 as pct_w, h * 100 as pct_h from drawn""",
    "g13_lit_points": f"with {NORM}, {POINTS} select det_id, scene_id, px, py from pts p where {LIT}",
    "g13_dim_points": f"with {NORM}, {POINTS} select scene_id, count(*) as n_dim from pts p where not {LIT} group by 1",
    "j6_iou_pairs": f"""with {NORM}, dis as (select scene_id, change_type, x, y, w, h, count(*) as n, {{'x': x, 'y': y, 'w': w, 'h': h}} as b
          from norm where w > 0 and h > 0 group by 1, 2, 3, 4, 5, 6)
        select p.scene_id, p.change_type, p.x as a_x, p.y as a_y, p.w as a_w, p.h as a_h, p.n as a_n,
          q.x as b_x, q.y as b_y, q.w as b_w, q.h as b_h, q.n as b_n, {iou_sql('p.', 'q.')} as iou
        from dis p join dis q on p.scene_id = q.scene_id and p.change_type = q.change_type
          and (p.b < q.b or (p.b = q.b and p.n > 1)) and {iou_sql('p.', 'q.')} > 0.4e0""",
    "n1_first_text": f"with {RESP} select event_id, case when event_id % 3 = 1 then '' else raw_text end as first_text from resp",
    "n2_strip_fences": f"""with {RESP} select event_id, case when {WRAPPED} then raw_text
        when shape = 1 then '{{"summary":"f","changes":[]}}' else raw_text end as body from resp""",
    "n3_parse_responses": f"""with {RESP} select event_id, failed, failure, summary,
        (select count(*) from truth t where t.shape = p.shape and not p.failed) as n_changes from parsed p""",
    "n4_explode_changes": f"""with {RESP} select event_id, cast(pos as bigint) as pos, category, change_type, description, confidence from found""",
    "n5_normalise": f"with {NORM} select det_id, category, change_type, description, confidence from norm",
    "n6_clamp_box": f"""with {NORM}, raw as (select det_id, case when det_id % 29 = 0 then 0 else x * 2 - 0.5e0 end as rx,
          case when det_id % 29 = 0 or det_id % 31 = 0 then 0 else y * 2 - 0.5e0 end as ry,
          case when det_id % 29 = 0 or det_id % 31 = 0 then 0 else w * 2 end as rw,
          case when det_id % 29 = 0 or det_id % 31 = 0 then 0 else h * 3 end as rh from det),
        cl as (select *, least(greatest(rx, 0), 1) as x, least(greatest(ry, 0), 1) as y from raw)
        select det_id, x, y, least(greatest(rw, 0), 1 - x) as w, least(greatest(rh, 0), 1 - y) as h from cl""",
    "n6_response_boxes": f"""with {RESP} select event_id, cast(pos as bigint) as pos, category, change_type, description, confidence, x, y, w, h from clean""",
    "n7_response_defaults": f"with {RESP} select event_id, 'chg-' || cast(pos + 1 as varchar) as id, summary, model from found",
    "n9_classify_errors": f"""with {RESP} select event_id, case when error is not null then
        case when http_status in (401, 403) or error = 'invalid x-api-key' then 'auth' else 'other' end end as error_class from resp""",
    "j3_confidence_pct": f"""with {NORM} select det_id, cast(pct as bigint) as confidence_pct, cast(pct as varchar) || '%' as confidence_label from
        (select det_id, case confidence when 'low' then 35 when 'medium' then 65 else 90 end as pct from norm)""",
    "j4_translate": f"""with {NORM}, {LABELS}, keyed as (select det_id, {LANG} as lg, {KEY4} as ky from norm)
        select det_id, {label_sql('keyed.lg', 'keyed.ky')} as words from keyed""",
    "j5_category_label": f"""with {NORM}, {LABELS}, keyed as (select det_id, category, {LANG} as lg, 'cat.' || category as ky from norm)
        select det_id, case when {label_sql('keyed.lg', 'keyed.ky')} = ky then category else {label_sql('keyed.lg', 'keyed.ky')} end as category_label from keyed""",
    "a1_counts_by_type": f"""{MERGED} select scene_id, count(*) filter (change_type = 'added') as n_added,
        count(*) filter (change_type = 'removed') as n_removed, count(*) filter (change_type = 'modified') as n_modified from merged group by 1""",
    "a2_visible_counts": f"{MERGED} select scene_id, count(*) filter ({VISIBLE}) as n_visible, count(*) as n_total from merged group by 1",
    "a3_failed_count": f"{RUN} select scene_id, n_tasks, n_failed from run",
    "a4_run_status": f"""with {RESP}, picked as (select scene_id, case scene_id % 3 when 0 then failed when 1 then true else false end as failed from parsed)
        select scene_id, case when count(*) filter (failed) = 0 then 'none' when count(*) filter (not failed) = 0 then 'all' else 'some' end as status
        from picked group by 1""",
    "a5_first_error": f"{RUN} select scene_id, first_error from run",
    "a6_summary_pick": f"{RUN} select scene_id, summary, n_changes from run",
    "a7_first_model": f"{RUN} select scene_id, model from run",
    "a8_progress": f"""with {TILES}, done as (select user_id as scene_id, count(*) as n from events group by 1)
        select t.scene_id, coalesce(max(d.n), 0) as done, count(*) as total from tiles t left join done d on d.scene_id = t.scene_id group by 1""",
    "a9_raster_range": f"with pix as ({fx.pixels_sql(fx.FLOAT_SAMPLE)}), {_range_cte()} select scene_id, lo, hi from lim",
    "d1_priority": f"""with {NORM} select det_id, row_number() over (partition by scene_id order by {RANK} desc, w * h desc, task_idx, pos) as priority from det""",
    "d2_dedupe": f"{MERGED} select det_id, scene_id, change_type from merged",
    "d2_dedupe_rounds": f"{MERGED} select det_id, scene_id, change_type from merged",
    "d3_reading_order": f"""with {NORM} select det_id, row_number() over (partition by scene_id order by y, x, {RANK} desc, w * h desc, task_idx, pos) as n from norm""",
    "d4_sequential_ids": f"{MERGED} select det_id, scene_id, 'chg-' || cast(n as varchar) as id from merged",
    "d5_stable_numbers": f"{MERGED} select det_id, n from merged where {VISIBLE}",
    "f1_type_filter": f"with {NORM} select det_id from norm where change_type in ('added', 'removed')",
    "f2_min_confidence": f"with {NORM} select det_id from det where confidence in ('medium', 'high', 'unsure')",
    "f3_text_search": f"with {NORM} select det_id from norm where contains(lower(description || ' ' || category), 'roof_a 50%')",
    "f4_visible_flag": f"""with {NORM} select det_id, change_type in ('added', 'modified') and confidence = 'high'
        and contains(lower(description || ' ' || category), 'hall') as visible from norm""",
    "x1_clamp01": f"with {NORM} select det_id, least(greatest(x * 3 - 0.5e0, 0), 1) as v from det",
    "x2_round_half_up": f"with {NORM} select det_id, cast(floor((det_id % 41 - 20) / 8.0e0 + 0.5e0) as bigint) as v from det",
    "x3_interpolate": f"""{MERGED}, {LABELS}, c as (select scene_id, count(*) filter ({VISIBLE}) as a, count(*) as b from merged group by 1),
        k as (select *, {HEADING_LANG} as lg, case when a <> b then 'report.headingOf' else 'report.heading' end as ky from c)
        select scene_id, replace(replace({label_sql('k.lg', 'k.ky')}, '{{n}}', cast(a as varchar)), '{{total}}', cast(b as varchar)) as heading from k""",
    "x3_error_text": f"""{RUN}, {LABELS}, k as (select *, {HEADING_LANG} as lg, case when status = 'all' then 'error.allFailed' else 'error.someFailed' end as ky from run)
        select scene_id, case when n_failed > 0 then replace(replace(replace({label_sql('k.lg', 'k.ky')}, '{{failed}}', cast(n_failed as varchar)),
          '{{total}}', cast(n_tasks as varchar)), '{{err}}', first_error) end as error_text from k""",
    "x7_grey": f"""with pix as ({fx.pixels_sql(fx.U8_SAMPLE)}) select scene_id, px, py,
        max(case when band = 0 then v end) * {RED}e0 + max(case when band = 1 then v end) * {GREEN}e0 + max(case when band = 2 then v end) * {BLUE}e0 as grey
        from pix group by 1, 2, 3""",
    "x8_keep_bands": _pixel_check(fx.U16_SAMPLE, where="band < 3"),
    "x9_u16_to_u8": f"with pix as ({fx.pixels_sql()}) select scene_id, band, cast(sum(cast(v as bigint) >> 8) as bigint) as total from pix where band < 3 group by 1, 2",
    "x10_rescale_u8": f"""with pix as ({fx.pixels_sql(fx.FLOAT_SAMPLE)}), {_range_cte()},
        done as (select p.scene_id, band, px, py, {STRETCHED} as v from pix p join lim l on l.scene_id = p.scene_id where band < 3)
        select scene_id, band, {CHECK} from done group by 1, 2""",
    "x10_rescale_by_dtype": f"""with pix as ({fx.pixels_sql()}), {_range_cte()},
        done as (select p.scene_id, band, px, py, case p.scene_id % 3 when 0 then v when 1 then cast(cast(v as bigint) >> 8 as double) else {STRETCHED} end as v
          from pix p join lim l on l.scene_id = p.scene_id where band < 3)
        select scene_id, band, {CHECK} from done group by 1, 2""",
    "g7_crop": f"""with pix as ({fx.pixels_sql()}),
        frames as (select s_suppkey as scene_id, {fx.RASTER_W} as work_w, {fx.RASTER_H} as work_h from supplier), {tiles_sql('frames', 10)}
        select t.scene_id, t.task_idx, band, count(*) as n, sum(v) as total,
          sum(v * (((px - x0) * 31 + (py - y0) * 17) % 97)) as placed
        from tiles t join pix p on p.scene_id = t.scene_id and px >= x0 and px < x0 + sw and py >= y0 and py < y0 + sh group by 1, 2, 3""",
    "g7_crop_scaled": f"""with pix as ({fx.pixels_sql()}),
        frames as (select s_suppkey as scene_id, {fx.RASTER_W} as work_w, {fx.RASTER_H} as work_h from supplier),
        {tiles_sql('frames', 10).replace('1500.0e0', '17.0e0').replace('1100.0e0', '7.0e0')},
        cut as (select t.scene_id, task_idx, band, v, px - x0 as i, py - y0 as j, sw, sh, out_w, out_h
          from tiles t join pix p on p.scene_id = t.scene_id and px >= x0 and px < x0 + sw and py >= y0 and py < y0 + sh),
        wide as (select *, unnest(range(i * out_w // sw, ((i + 1) * out_w - 1) // sw + 1)) as ox from cut),
        high as (select *, unnest(range(j * out_h // sh, ((j + 1) * out_h - 1) // sh + 1)) as oy from wide),
        reduced as (select scene_id, task_idx, band, ox, oy, floor(sum(v * (least((i + 1) * out_w, (ox + 1) * sw) - greatest(i * out_w, ox * sw))
            * (least((j + 1) * out_h, (oy + 1) * sh) - greatest(j * out_h, oy * sh))) / any_value(sw * sh) + 0.5e0) as v from high group by 1, 2, 3, 4, 5)
        select scene_id, task_idx, band, count(*) as n, sum(v) as total, sum(v * ((ox * 31 + oy * 17) % 97)) as placed
        from reduced group by 1, 2, 3""",
    "j7_knn_hamming": f"with {KNN} select cast(scene_id as bigint) as scene_id, q_id, k, t_id, distance from near where k <= 2",
    "d6_top_two": f"""with {KNN} select cast(scene_id as bigint) as scene_id, q_id, max(case when k = 1 then distance end) as d1,
        max(case when k = 2 then distance end) as d2 from near where k <= 2 group by 1, 2""",
    "f6_ratio_test": f"with {KNN} select cast(scene_id as bigint) as scene_id, q_id, t_id, distance from ratio",
    "f5_match_gate": f"with {KNN_ODD} select distinct cast(scene_id as bigint) as scene_id, match_count from good",
    "r1_match_descriptors": f"with {KNN} select cast(scene_id as bigint) as scene_id, q_id, t_id, sx, sy, dx, dy from good",
    "r3_project_points": f"""with {fx.keypoints_sql()} select cast(scene_id as bigint) as scene_id, kp_id,
        ({_H[0]} * x + {_H[1]} * y + {_H[2]}) / {_depth} as hx, ({_H[3]} * x + {_H[4]} * y + {_H[5]}) / {_depth} as hy from later""",
    "r4_warp_shift": _warp_sql(40, 30, "px - 3.0e0", "py - 2.0e0"),
    "r4_warp_perspective": _warp_sql(
        56, 40, "(-0.625e0 * px + 0.625e0 * py + -1.00048828125e0) / (-0.0625e0 * px + 0.0625e0 * py + 0.96875e0)",
        "(0.082061767578125e0 * px + -0.75006103515625e0 * py + -0.937957763671875e0) / (-0.0625e0 * px + 0.0625e0 * py + 0.96875e0)"),
    "r5_fallback_resize": _warp_sql(64, 48, "px * 0.5e0", "py * 0.5e0"),
    "r4_resize_earlier": _warp_sql(16, 12, "px * 2.0e0", "py * 2.0e0", fx.EARLIER_U8_SAMPLE),
    "e3_run_images": f"""with late as ({fx.pixels_sql(fx.U8_SAMPLE)}), early as ({fx.pixels_sql(fx.EARLIER_U8_SAMPLE)}),
        sums as (select scene_id, sum(v) as s from late where band = 0
          and (scene_id % 2 = 1 or px < {fx.RASTER_W - fx.LATER_SHIFT[0]} and py < {fx.RASTER_H - fx.LATER_SHIFT[1]}) group by 1),
        diffs as (select e.scene_id, cast(sum(e.v) - any_value(l.s) as bigint) as brighter from early e join sums l on l.scene_id = e.scene_id
          where e.band = 0 group by 1)
        select scene_id, cast(1 as bigint) as n, case brighter % 3 when 0 then 'added' when 1 then 'removed' else 'modified' end as change_type,
          'high' as confidence, 'brighter by ' || cast(brighter as varchar) as description,
          0.25e0 as x, 0.25e0 as y, 0.5e0 as w, 0.5e0 as h from diffs""",
    "r2_fit_homography": f"""with {KNN}, placed as (select *, {_under('sx', 'sy')} from good)
        select cast(scene_id as bigint) as scene_id, count(*) filter ((hx - dx) ** 2 + (hy - dy) ** 2 <= 25) as inliers, true as corners_agree
        from placed group by 1""",
    "r6_align_status": f"""with {KNN_ODD}, frames as (select label as scene_id, count(*) + 200 as work_w from embeddings group by 1),
        fit as (select distinct scene_id, match_count from good where scene_id <> 1)
        select cast(f.scene_id as bigint) as scene_id, work_w, cast(256 as bigint) as work_h, g.scene_id is not null as aligned,
          coalesce(g.match_count, 0) as match_count, true as corners_agree from frames f left join fit g on g.scene_id = f.scene_id""",
    "v1_detect": f"""with {TILES}, coded as (select scene_id, task_idx, scene_id + task_idx as code from tiles)
        select scene_id, task_idx, case when code % 5 <> 0 then '{{"summary":"","changes":[{{"category":"house","change_type":"' ||
          case code % 3 when 0 then 'added' when 1 then 'removed' else 'modified' end || '","description":"tile ' || cast(task_idx as varchar) ||
          '","confidence":"' || case code % 2 when 0 then 'low' else 'medium' end || '","bbox":[0.25,0.25,0.5,0.75]}}]}}' end as raw_text,
          case when code % 5 = 0 then 'no answer ' || cast(code as varchar) end as error from coded""",
    "v1_detect_resumed": f"""with {TILES}, coded as (select scene_id, task_idx, scene_id + task_idx as code from tiles)
        select scene_id, task_idx, case when code % 5 <> 0 then '{{"summary":"","changes":[{{"category":"house","change_type":"' ||
          case code % 3 when 0 then 'added' when 1 then 'removed' else 'modified' end || '","description":"tile ' || cast(task_idx as varchar) ||
          '","confidence":"' || case code % 2 when 0 then 'low' else 'medium' end || '","bbox":[0.25,0.25,0.5,0.75]}}]}}' end as raw_text,
          case when code % 5 = 0 then 'no answer ' || cast(code as varchar) end as error,
          cast(case when scene_id % 3 <> 0 and code % 5 <> 0 then 1 else 2 end as bigint) as attempt from coded""",
    "e1_run_changes": f"{RUN_ALL} select scene_id, n, change_type, confidence, description, x, y, w, h from merged",
    "e2_run_summary": f"{RUN_ALL} select scene_id, summary, model, n_changes, n_tasks, n_failed, first_error, status from run",
    "e4_run_requests": """with coded as (select doc_id as scene_id, doc_id % 7 as code, coalesce(text, '') as whole from documents)
        select scene_id, case code when 3 then 's-one' when 4 then 'n-small' else 'n-large' end as model, code in (1, 2, 3) as failed,
          case when code = 3 then 'auth' when code in (1, 2) then 'other' end as error_class,
          case code when 1 then 'reference and target are required' when 2 then 'image data URLs are required'
            when 3 then '403 for this model' end as failure,
          case when code not in (1, 2, 3) then
            concat(length(base64(encode(whole))), ' and ', length(base64(encode(array_to_string(list_slice(string_split(whole, ''), 1, 10), ''))))) end
            as description from coded""",
}
