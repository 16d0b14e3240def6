"""Independent DuckDB SQL for every query that SQL can express.

The driver registers the parquet tables as views; these strings only use those views.
Derived inputs (masks, qa) are rebuilt here with the same integer rules as
``sources.derived``; the class and cell dictionaries are rendered from
``constants`` as VALUES lists.
"""

from __future__ import annotations

from .. import constants as K
from ..sources.derived import MASK_CODES


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CLASSES_CTE = "classes(code, name, class_ord) AS (VALUES " + ", ".join(
    f"({c}, {_q(n)}, {i})" for i, (c, n) in enumerate(K.CLASS_CODES_AND_NAMES)
) + ")"
IDS_CTE = "ids(code, id) AS (VALUES " + ", ".join(f"({c}, {i})" for i, c in enumerate(K.ID_CODES)) + ")"
CELL_SQL = "(['a','b','c','d'][({g}) % 4 + 1] || CAST(({g}) // 4 + 1 AS VARCHAR))"

MASK_PX_CTE = f"""mask_src AS (
    SELECT s_suppkey, s_name AS img_name,
           CASE WHEN s_suppkey % 10 = 8 THEN 100 WHEN s_suppkey % 10 = 9 THEN 130 ELSE 120 END AS side
    FROM supplier),
mask_px AS (
    SELECT img_name, side, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y,
           {list(MASK_CODES)}[1 + CAST((s_suppkey * 7 + (x // 12) * 3 + (y // 10) * 5 + (x * y) % 3) % {len(MASK_CODES)} AS INTEGER)] AS code
    FROM mask_src, range(130) tx(x), range(130) ty(y)
    WHERE x < side AND y < side),
grid_px AS (
    SELECT img_name, x, y, CAST((y // 30) * 4 + x // 30 AS INTEGER) AS grid_ord, code
    FROM mask_px WHERE x < 120 AND y < 120)"""

AREA_CTE = f"""{CLASSES_CTE},
{MASK_PX_CTE},
cnt AS (
    SELECT img_name, grid_ord, code, count(*) AS n FROM grid_px GROUP BY ALL),
dense AS (
    SELECT img_name, CAST(g AS INTEGER) AS grid_ord, code, name, class_ord
    FROM (SELECT DISTINCT img_name FROM mask_src), range(16) tg(g), classes),
area AS (
    SELECT d.img_name, {CELL_SQL.format(g='d.grid_ord')} AS grid, d.grid_ord, d.name AS class,
           CAST(d.class_ord AS INTEGER) AS class_ord,
           CAST(CASE WHEN coalesce(c.n, 0) < 30 THEN 0 ELSE c.n END * 100 AS BIGINT) AS value
    FROM dense d LEFT JOIN cnt c ON c.img_name = d.img_name AND c.grid_ord = d.grid_ord AND c.code = d.code)"""


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


ORACLE: dict[str, str] = {}

ORACLE["grid_counts"] = with_(
    f"{CLASSES_CTE},\n{MASK_PX_CTE}",
    f"""SELECT p.img_name, {CELL_SQL.format(g='p.grid_ord')} AS grid, p.grid_ord, c.name AS class,
       CAST(c.class_ord AS INTEGER) AS class_ord, count(*) AS n
FROM grid_px p JOIN classes c ON p.code = c.code
GROUP BY ALL""",
)

ORACLE["grid_cells"] = with_(
    MASK_PX_CTE,
    f"""SELECT img_name, {CELL_SQL.format(g='grid_ord')} AS grid, grid_ord, count(*) AS n
FROM grid_px GROUP BY ALL""",
)

ORACLE["image_classes"] = with_(MASK_PX_CTE, "SELECT DISTINCT img_name, code FROM mask_px")

ORACLE["grid_area"] = with_(AREA_CTE, "SELECT * FROM area")

ORACLE["grid_pivot"] = with_(
    AREA_CTE,
    "SELECT img_name, grid AS \"Grid\", "
    + ", ".join(f"CAST(sum(value) FILTER (WHERE class = {_q(n)}) AS BIGINT) AS \"{n}\"" for n in K.CLASS_NAMES)
    + "\nFROM area GROUP BY img_name, grid",
)

NAMES_LIST = "[" + ", ".join(_q(n) for n in K.CLASS_NAMES) + "]"
QA_CTE = f"""per_line AS (
    SELECT l_orderkey, l_linenumber,
           list_sort(list_distinct(list(CASE WHEN l_partkey % 17 < 16
                THEN {CELL_SQL.format(g='CAST(l_partkey % 17 AS INTEGER)')} ELSE 'z9' END))) AS cells,
           list_distinct(list(CAST(l_partkey % 43 AS INTEGER))) AS ords,
           min(l_suppkey) AS min_supp
    FROM lineitem GROUP BY ALL),
per_order AS (
    SELECT l_orderkey, list(cells ORDER BY l_linenumber) AS grid_coordinates,
           list_sort(list_distinct(flatten(list(ords)))) AS ords, min(min_supp) AS min_supp
    FROM per_line GROUP BY ALL),
qa AS (
    SELECT o.o_orderkey AS index, s.s_name AS img_name, o.o_orderpriority AS question,
           o.o_orderstatus AS question_type,
           CASE WHEN p.ords IS NOT NULL
                THEN array_to_string(list_transform(p.ords, lambda o: {NAMES_LIST}[o + 1]), ', ') END AS answer,
           coalesce(p.grid_coordinates, []) AS grid_coordinates, p.ords AS ords
    FROM orders o LEFT JOIN per_order p ON o.o_orderkey = p.l_orderkey
    LEFT JOIN supplier s ON s.s_suppkey = p.min_supp)"""

TABLE_TEXT_CTE = """tt AS (
    SELECT img_name,
           coalesce(string_agg(CASE WHEN value <> 0 THEN '(' || class || ',' || grid || '):' || CAST(value AS VARCHAR) END,
                               ',' ORDER BY grid_ord, class_ord), '') AS tbl
    FROM area GROUP BY img_name)"""

ORACLE["qa_scan"] = with_(
    QA_CTE,
    """SELECT index, img_name, question, question_type, answer,
       CAST(len(grid_coordinates) AS INTEGER) AS n_lines, array_to_string(flatten(grid_coordinates), ' ') AS coords
FROM qa""",
)

ORACLE["head_rows"] = with_(QA_CTE, "SELECT index, img_name, question FROM qa ORDER BY index LIMIT 10")

ORACLE["prompt_text"] = with_(
    f"{AREA_CTE},\n{QA_CTE},\n{TABLE_TEXT_CTE}",
    "SELECT q.index, 'Question: ' || q.question || '; Table: ' || coalesce(tt.tbl, '') AS text\n"
    "FROM qa q LEFT JOIN tt ON tt.img_name = q.img_name",
)

ORACLE["missing_context"] = with_(
    f"{MASK_PX_CTE},\n{QA_CTE}",
    "SELECT q.index, q.img_name, q.question FROM qa q\n"
    "WHERE NOT EXISTS (SELECT 1 FROM mask_src m WHERE m.img_name = q.img_name)",
)

ORACLE["flat_context"] = with_(
    AREA_CTE,
    "SELECT img_name, string_agg(CAST(value AS VARCHAR), ',' ORDER BY grid_ord, class_ord) AS \"values\"\n"
    "FROM area GROUP BY img_name",
)

CELLS_LIST = "[" + ", ".join(_q(c) for c in K.CELL_NAMES) + "]"

ORACLE["json_vocab"] = """SELECT k AS token, CAST(json_extract(props, '$."' || k || '"') AS INTEGER) AS id, count(*) AS n
FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL"""

ORACLE["patch_labels"] = with_(
    QA_CTE,
    "SELECT index, array_to_string(list_sort(list_distinct(flatten(grid_coordinates))), ',') AS labels FROM qa",
)

ORACLE["patch_multihot"] = with_(
    f"""{QA_CTE},
lab AS (SELECT index, list_transform(list_distinct(flatten(grid_coordinates)),
            lambda t: ((coalesce(list_position({CELLS_LIST}, t) - 1, -1) % 16) + 16) % 16) AS ids FROM qa)""",
    "SELECT index, array_to_string(list_transform(range(16), lambda i: CASE WHEN list_contains(ids, i) THEN '1' ELSE '0' END), '') AS bits FROM lab",
)

ORACLE["answer_ids"] = with_(
    QA_CTE,
    "SELECT index, CAST(coalesce(len(ords), 0) AS INTEGER) AS n_tokens, coalesce(array_to_string(ords, ','), '') AS ids FROM qa",
)

ORACLE["answer_multihot"] = with_(
    QA_CTE,
    "SELECT index, CAST(coalesce(len(ords), 0) AS INTEGER) AS n_hot,\n"
    "       array_to_string(list_transform(range(335), lambda i: CASE WHEN list_contains(coalesce(ords, []), i) THEN '1' ELSE '0' END), '') AS bits\n"
    "FROM qa",
)

ORACLE["remap_codes"] = with_(
    f"{IDS_CTE},\n{MASK_PX_CTE}",
    "SELECT m.img_name, CAST(coalesce(i.id, 0) AS INTEGER) AS id, count(*) AS n\n"
    "FROM mask_px m LEFT JOIN ids i ON m.code = i.code GROUP BY ALL",
)

SCORES_SQL = "list_transform(range(44), lambda c: CAST(embedding[c + 1] AS DOUBLE) + coalesce(CAST(embedding[c + 45] AS DOUBLE), 0.0))"
ORACLE["fit_pixels"] = with_(
    f"{IDS_CTE},\n{MASK_PX_CTE}",
    "SELECT CAST(id AS INTEGER) AS id, ids.code AS code, n, true AS beats_majority\n"
    "FROM (SELECT coalesce(i.id, 0) AS id, count(*) AS n FROM mask_px m LEFT JOIN ids i ON m.code = i.code GROUP BY 1) JOIN ids USING (id)",
)

ORACLE["fit_forest"] = with_(
    f"{MASK_PX_CTE},\n{IDS_CTE}",
    """SELECT model, n, majority, true AS beats_majority FROM (VALUES ('linear'), ('forest')) m(model),
    (SELECT CAST(sum(c) AS BIGINT) AS n, max(c) AS majority FROM (
        SELECT coalesce(id, 0) AS id, count(*) AS c FROM mask_px LEFT JOIN ids USING (code) WHERE right(img_name, 1) IN ('0', '5') GROUP BY 1))""",
)

ORACLE["predicted_mask"] = (
    "SELECT vec_id, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS id,\n"
    f"       {list(K.ID_CODES)}[list_position(z, list_max(z))] AS code\n"
    f"FROM (SELECT vec_id, {SCORES_SQL} AS z FROM embeddings)"
)

ORACLE["strip_suffix"] = """SELECT s_suppkey, path,
       left(b, greatest(length(b) - 18, 0)) || '.parquet' AS out_name
FROM (SELECT s_suppkey, path, string_split(path, '/')[-1] AS b
      FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'masks/short.tif'
                                   ELSE 'masks/' || s_name || '_reference_map.tif' END AS path FROM supplier))"""

MANIFEST_CTE = """manifest AS (
    SELECT s.s_name AS img_name, n.n_name AS path_to_your_file,
           CASE WHEN s.s_suppkey % 5 = 0 THEN 'val' ELSE 'train' END AS split
    FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey)"""

ORACLE["manifest_scan"] = with_(MANIFEST_CTE, "SELECT split, count(*) AS n FROM manifest GROUP BY split")

ORACLE["manifest_paths"] = with_(
    MANIFEST_CTE,
    "SELECT img_name, split, 'images/' || img_name || '.tif' AS img_path,\n"
    "       'masks/' || path_to_your_file || '/' || img_name || '_reference_map.tif' AS mask_path FROM manifest",
)

ORACLE["manifest_join"] = with_(
    f"{MANIFEST_CTE},\n{MASK_PX_CTE}",
    "SELECT m.img_name, m.split, m.path_to_your_file AS folder, CAST(s.side AS INTEGER) AS height, CAST(s.side AS INTEGER) AS width\n"
    "FROM manifest m JOIN mask_src s ON s.img_name = m.img_name",
)

ORACLE["resize_bilinear"] = """WITH g AS (
    SELECT vec_id, embedding AS e, CAST(oy AS INTEGER) AS y, CAST(ox AS INTEGER) AS x,
           greatest((CAST(oy AS DOUBLE) + 0.5) * 8 / 15 - 0.5, 0.0) AS sy,
           greatest((CAST(ox AS DOUBLE) + 0.5) * 8 / 15 - 0.5, 0.0) AS sx
    FROM embeddings, range(15) a(oy), range(15) b(ox)),
h AS (SELECT *, CAST(floor(sy) AS INTEGER) AS y0, CAST(floor(sx) AS INTEGER) AS x0 FROM g),
k AS (SELECT *, least(y0 + 1, 7) AS y1, least(x0 + 1, 7) AS x1, sy - y0 AS wy, sx - x0 AS wx FROM h)
SELECT vec_id, y, x,
       round((1.0 - wy) * ((1.0 - wx) * CAST(e[y0 * 8 + x0 + 1] AS DOUBLE) + wx * CAST(e[y0 * 8 + x1 + 1] AS DOUBLE))
             + wy * ((1.0 - wx) * CAST(e[y1 * 8 + x0 + 1] AS DOUBLE) + wx * CAST(e[y1 * 8 + x1 + 1] AS DOUBLE)), 6) AS v
FROM k"""

_MEAN, _STD = K.NORM_MULTISPECTRAL
_DLIST = lambda xs: "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in xs) + "]"
def _bytes_sql(name: str, h: int, w: int) -> str:
    def axis(n_out: int) -> str:
        return f"""(SELECT o, i, CAST(floor(0.5 + f / sum(f) OVER (PARTITION BY o) * 4194304) AS BIGINT) AS k FROM (
            SELECT o, i, greatest(0.0, 1.0 - abs((i - c + 0.5) * (1.0 / wide))) AS f FROM (
                SELECT o, (o + 0.5::DOUBLE) * (8::DOUBLE / {n_out}) AS c, greatest(8::DOUBLE / {n_out}, 1.0) AS wide FROM range({n_out}) t(o)), range(8) u(i)
            WHERE i >= trunc(c - wide + 0.5) AND i < trunc(c + wide + 0.5)))"""

    rounded = "CAST(least(255, greatest(0, (2097152 + sum(v * k)) >> 22)) AS INTEGER)"
    return f"""SELECT vec_id, '{name}' AS size, CAST(a.o AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {rounded.replace('sum(v * k)', 'CAST(sum(v * k) AS BIGINT)')} AS v FROM (
    SELECT vec_id, y, a.o AS x, {rounded.replace('sum(v * k)', 'CAST(sum(v * k) AS BIGINT)')} AS v FROM px JOIN {axis(w)} a ON px.x = a.i GROUP BY vec_id, y, a.o) r
JOIN {axis(h)} a ON r.y = a.i GROUP BY vec_id, a.o, x"""


ORACLE["resize_bytes"] = f"""WITH px AS (
    SELECT vec_id, i // 8 AS y, i % 8 AS x, CAST(greatest(0, least(255, floor((CAST(embedding[i + 1] AS DOUBLE) + 1) * 128))) AS BIGINT) AS v
    FROM embeddings, range(64) t(i))
{_bytes_sql("large", 15, 13)}
UNION ALL {_bytes_sql("small", 5, 3)}"""

ORACLE["normalize_bands"] = f"""SELECT vec_id, CAST(b AS INTEGER) AS band, CAST(i AS INTEGER) AS i,
       round((CAST(embedding[i + 1] AS DOUBLE) / 255.0 - {_DLIST(_MEAN)}[b + 1]) / {_DLIST(_STD)}[b + 1], 6) AS v
FROM embeddings, range(3) tb(b), range(64) ti(i)"""

ORACLE["masked_mean_pool"] = """SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(sum(CAST(h AS DOUBLE) * m) / sum(m), 6) AS pooled
FROM (SELECT label, CASE WHEN vec_id % 5 <> 0 THEN 1 ELSE 0 END AS m,
             unnest(embedding) AS h, generate_subscripts(embedding, 1) AS i FROM embeddings)
GROUP BY ALL"""

ORACLE["score_heads"] = """SELECT vec_id, CAST(j AS INTEGER) AS label,
       round(1.0 / (1.0 + exp(-(sum(tanh(CAST(h AS DOUBLE)) * (CAST(((i * 7 + j * 3) % 11) - 5 AS DOUBLE) / 10))
                                + CAST(((j * 5) % 7) - 3 AS DOUBLE) / 20))), 6) AS score
FROM (SELECT vec_id, unnest(embedding) AS h, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), range(16) t(j)
GROUP BY vec_id, j"""

CE_SQL = f"""(SELECT vec_id, label, m + ln(list_sum(list_transform(z, lambda x: exp(CAST(x AS DOUBLE) - m))))
                    - CAST(z[label + 1] AS DOUBLE) AS loss
     FROM (SELECT vec_id, label, z, list_max(z) AS m FROM (SELECT vec_id, label, {SCORES_SQL} AS z FROM embeddings)))"""

ORACLE["softmax_ce"] = f"SELECT vec_id, vec_id // 32 AS batch, round(loss, 6) AS loss FROM {CE_SQL}"

_P = "(1.0 / (1.0 + exp(-10.0 * CAST(embedding[{o} + j + 1] AS DOUBLE))))"
_TERM = "-({y} * greatest(ln({p}), -100) + (1.0 - {y}) * greatest(ln(1.0 - {p}), -100))"
ORACLE["bce_loss"] = f"""WITH rows AS (
    SELECT vec_id // 32 AS batch,
           list_sum(list_transform(range(16), lambda j: {_TERM.format(y="CASE WHEN j = label THEN 1.0 ELSE 0.0 END", p=_P.format(o=0))})) / 16 AS lp,
           list_sum(list_transform(range(48), lambda j: {_TERM.format(y="CASE WHEN (label * 5 + j) % 7 = 0 THEN 1.0 ELSE 0.0 END", p=_P.format(o=16))})) / 48 AS la
    FROM embeddings)
SELECT batch, count(*) AS n, round(avg(lp), 6) AS loss_patch, round(avg(la), 6) AS loss_answ,
       round(0.0 * avg(lp) + 1.0 * avg(la), 6) AS loss
FROM rows GROUP BY batch"""

ORACLE["epoch_metrics"] = f"""WITH rows AS (
    SELECT CASE WHEN vec_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, vec_id // 32 AS batch, loss FROM {CE_SQL}),
b AS (SELECT split, batch, count(*) AS n, avg(loss) AS loss FROM rows GROUP BY ALL)
SELECT split, round(avg(loss), 6) AS loss, round(sum(loss * n) / sum(n), 6) AS row_mean,
       count(*) AS n_batches, CAST(sum(n) AS BIGINT) AS n_rows
FROM b GROUP BY split"""

_LP = f"list_sum(list_transform(range(16), lambda j: {_TERM.format(y='CASE WHEN j = label THEN 1.0 ELSE 0.0 END', p=_P.format(o=0))})) / 16"
_LA = f"list_sum(list_transform(range(48), lambda j: {_TERM.format(y='CASE WHEN (label * 5 + j) % 7 = 0 THEN 1.0 ELSE 0.0 END', p=_P.format(o=16))})) / 48"
ORACLE["epoch_record"] = f"""WITH rows AS (SELECT vec_id // 32 AS batch, {_LP} AS lp, {_LA} AS la FROM embeddings),
b AS (SELECT batch // 10 AS epoch, batch % 5 = 0 AS val, 0.25 * avg(lp) + 0.75 * avg(la) AS loss FROM rows GROUP BY batch)
SELECT 'embeddings' AS run, epoch, round(avg(loss) FILTER (WHERE NOT val), 6) AS train_loss, round(avg(loss) FILTER (WHERE val), 6) AS val_loss
FROM b GROUP BY epoch"""

ORACLE["score_vqa"] = """WITH pooled AS (
    SELECT label, i - 1 AS i, sum(CAST(h AS DOUBLE) * m) / sum(m) AS x
    FROM (SELECT label, CASE WHEN vec_id % 5 <> 0 THEN 1 ELSE 0 END AS m,
                 unnest(embedding) AS h, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL)
SELECT label, head, CAST(j AS INTEGER) AS slot,
       round(1.0 / (1.0 + exp(-(sum(tanh(x) * (CAST(((i * 7 + j * 3) % 11) - 5 AS DOUBLE) / 10)) + CAST(((j * 5) % 7) - 3 AS DOUBLE) / 20))), 6) AS score
FROM pooled, (SELECT 'patch' AS head, unnest(range(16)) AS j UNION ALL SELECT 'answ' AS head, unnest(range(335)) AS j) GROUP BY label, head, j"""

def _train_sql() -> str:
    """Two AdamW steps on all train rows; the bias is the last place of x and w."""
    p = "1.0 / (1.0 + exp(-list_inner_product(x, w)))"
    loss = "-a / slots * (CASE WHEN y THEN greatest(ln(p), -100) ELSE greatest(ln(1.0 - p), -100) END)"
    ctes = [
        """x AS (SELECT vec_id, label, vec_id % 5 = 0 AS val, list_concat(list_transform(embedding, lambda e: tanh(CAST(e AS DOUBLE))), [1.0::DOUBLE]) AS x
    FROM embeddings),
heads(head, slots, a) AS (VALUES ('patch', 16, 0.25::DOUBLE), ('answ', 335, 0.75::DOUBLE)),
w0 AS (SELECT head, slots, a, j, list_concat(list_transform(range(64), lambda i: CAST((i * 7 + j * 3) % 11 - 5 AS DOUBLE) / 10), [CAST((j * 5) % 7 - 3 AS DOUBLE) / 20]) AS w
    FROM heads, range(335) t(j) WHERE j < slots)"""
    ]
    for k in (0, 1, 2):
        ctes.append(f"""p{k} AS (SELECT val, head, slots, a, j, x, CASE WHEN head = 'patch' THEN j = label ELSE (label * 5 + j) % 7 = 0 END AS y, {p} AS p FROM x, w{k}),
l{k} AS (SELECT val, sum({loss}) AS loss FROM p{k} GROUP BY val),
m{k} AS (SELECT l{k}.val, loss / n AS loss FROM l{k} JOIN (SELECT val, count(*) AS n FROM x GROUP BY val) c ON l{k}.val = c.val)""")
        if k == 2:
            break
        old = ", o.m, o.v" if k else ", 0.0::DOUBLE AS m, 0.0::DOUBLE AS v"
        before = f"LEFT JOIN s{k - 1} o ON o.head = g.head AND o.j = g.j AND o.i = g.i" if k else ""
        ctes.append(f"""g{k} AS (SELECT head, j, i, sum((p - CASE WHEN y THEN 1.0 ELSE 0.0 END) * x[i]) * any_value(a / slots) / (SELECT count(*) FROM x WHERE NOT val) AS g
    FROM p{k}, range(1, 66) t(i) WHERE NOT val GROUP BY head, j, i),
s{k} AS (SELECT head, j, i, 0.9 * m + 0.1 * g AS m, 0.999 * v + 0.001 * g * g AS v FROM (SELECT g.*{old} FROM g{k} g {before})),
w{k + 1} AS (SELECT w.head, slots, a, w.j, list(w[i] * (1.0 - 0.01 * 0.01) - 0.01 * (m / (1.0 - 0.9 ** {k + 1})) / (sqrt(v / (1.0 - 0.999 ** {k + 1})) + 1e-8) ORDER BY i) AS w
    FROM w{k} w JOIN s{k} s ON w.head = s.head AND w.j = s.j GROUP BY ALL)""")
    rows = [f"SELECT 'embeddings' AS run, {k + 1} AS epoch, round(t.loss, 6) AS train_loss, round(v.loss, 6) AS val_loss FROM m{k} t, m{k + 1} v WHERE NOT t.val AND v.val" for k in (0, 1)]
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(rows)


ORACLE["train_heads"] = _train_sql()

def _predicted_sql(side: int = 120, n_in: int = 8) -> str:
    """Per pixel the 44 classes' values in a list, class c from the 64 values rotated by c; the first maximum's code counts."""
    def tap(y: str, x: str, c: int) -> str:
        return f"e[{y} * {n_in} + {x} + {c + 1}]"

    def value(c: int) -> str:
        top = f"(1.0 - wx) * {tap('y0', 'x0', c)} + wx * {tap('y0', 'x1', c)}"
        bottom = f"(1.0 - wx) * {tap('y1', 'x0', c)} + wx * {tap('y1', 'x1', c)}"
        return f"(1.0 - wy) * ({top}) + wy * ({bottom})"

    return with_(
        f"""{CLASSES_CTE},
{IDS_CTE},
ax AS (SELECT o, i, least(i + 1, {n_in - 1}) AS j, s - i AS w FROM (SELECT o, s, CAST(floor(s) AS BIGINT) AS i
    FROM (SELECT o, greatest((o + 0.5::DOUBLE) * {n_in} / {side} - 0.5, 0.0) AS s FROM range({side}) t(o)))),
px AS (SELECT y.o AS oy, x.o AS ox, y.i AS y0, y.j AS y1, y.w AS wy, x.i AS x0, x.j AS x1, x.w AS wx FROM ax y, ax x),
img AS (SELECT CAST(vec_id AS VARCHAR) AS img_name, list_transform(list_concat(embedding, embedding[1:44]), lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
best AS (SELECT img_name, oy, ox, list_position(z, list_max(z)) - 1 AS id FROM (SELECT img_name, oy, ox, [{', '.join(value(c) for c in range(44))}] AS z FROM img, px)),
cnt AS (SELECT img_name, CAST((oy // 30) * 4 + ox // 30 AS INTEGER) AS grid_ord, code, count(*) AS n FROM best JOIN ids USING (id) GROUP BY ALL),
dense AS (SELECT img_name, CAST(g AS INTEGER) AS grid_ord, code, name, class_ord FROM img, range(16) tg(g), classes)""",
        f"""SELECT d.img_name, {CELL_SQL.format(g='d.grid_ord')} AS grid, d.grid_ord, d.name AS class, CAST(d.class_ord AS INTEGER) AS class_ord,
       CAST(CASE WHEN coalesce(c.n, 0) < 30 THEN 0 ELSE c.n END * 100 AS BIGINT) AS value
FROM dense d LEFT JOIN cnt c ON c.img_name = d.img_name AND c.grid_ord = d.grid_ord AND c.code = d.code""",
    )


ORACLE["predicted_raster"] = _predicted_sql()

ORACLE["duplicate_images"] = """SELECT left(s_name, length(s_name) - 2) AS img_name, count(*) AS rasters
FROM supplier GROUP BY 1 HAVING count(*) > 1"""

def _epochs_sql(size: int, epochs: int, seed: int) -> str:
    """Six Feistel rounds per step, written out; places outside 0 to n - 1 walk on by recursion."""
    def mixed(x: str, i: int) -> str:
        key = f"(({(seed * 1_000_003 + i * 104_729) % 2_147_483_647} + epoch * 7919) % 2147483647)"
        y = f"(({x} * 48271 + {key}) % 2147483647)"
        return f"(({y} * {y} % 2147483647 + {y} * 16807 + {key}) % 2147483647)"

    ctes = []
    for i in range(6):
        l, r = (f"(l + {mixed('r', i)}) % a", "r") if i % 2 == 0 else ("l", f"(r + {mixed('l', i)}) % b")
        ctes.append(f"(SELECT vec_id, epoch, step, n, a, b, {l} AS l, {r} AS r FROM ")
    network = "".join(reversed(ctes)) + "(SELECT vec_id, epoch, step + 1 AS step, n, a, b, x % a AS l, x // a AS r FROM {src})" + ")" * 6
    return f"""WITH RECURSIVE c AS (SELECT count(*) AS n FROM embeddings),
d AS (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM c),
s AS (SELECT vec_id, CAST(e AS INTEGER) AS epoch, 0 AS step, n, a, (n + a - 1) // a AS b, row_number() OVER (PARTITION BY e ORDER BY vec_id) - 1 AS x
    FROM embeddings, d, range({epochs}) t(e)),
w AS (SELECT * FROM s
    UNION ALL SELECT vec_id, epoch, step, n, a, b, r * a + l AS x FROM {network.format(src='(SELECT * FROM w WHERE step = 0 OR x >= n)')})
SELECT vec_id, epoch, x AS pos, x // {size} AS batch FROM w WHERE step > 0 AND x < n"""


ORACLE["shuffle_epochs"] = _epochs_sql(32, 3, 7)

ORACLE["shuffle_batches"] = """SELECT vec_id, pos, pos // 32 AS batch
FROM (SELECT vec_id, row_number() OVER (ORDER BY (vec_id * 7919) % 1000003, vec_id) - 1 AS pos FROM embeddings)"""


def _encode_sql(max_length: int) -> str:
    budget = max_length - 3
    return f"""WITH toks AS (SELECT unnest(string_split(text, ' ')) AS token FROM conversations),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY count(*) DESC, token) - 1 + 4 AS INTEGER) AS id
          FROM toks GROUP BY token),
pairs AS (SELECT a.conv_id, a.turn, a.text AS ta, b.text AS tb FROM conversations a
          JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'),
sides AS (SELECT conv_id, turn, 0 AS side, string_split(ta, ' ') AS w FROM pairs
          UNION ALL SELECT conv_id, turn, 1 AS side, string_split(tb, ' ') AS w FROM pairs),
pos AS (SELECT conv_id, turn, side, unnest(w) AS token, generate_subscripts(w, 1) AS p FROM sides),
ids AS (SELECT conv_id, turn,
               list(v.id ORDER BY p) FILTER (WHERE side = 0) AS a,
               list(v.id ORDER BY p) FILTER (WHERE side = 1) AS b
        FROM pos JOIN vocab v USING (token) GROUP BY conv_id, turn),
lens AS (SELECT *, CAST(len(a) AS INTEGER) AS na, CAST(len(b) AS INTEGER) AS nb FROM ids),
cut AS (SELECT *, greatest(na + nb - {budget}, 0) AS r FROM lens),
cut2 AS (SELECT *, least(abs(na - nb), r) AS f, r - least(abs(na - nb), r) AS s FROM cut),
fin AS (SELECT conv_id, turn, a, b,
               CAST(CASE WHEN na > nb THEN na - f - s // 2 ELSE na - s // 2 END AS INTEGER) AS len_a,
               CAST(CASE WHEN na > nb THEN nb - (s - s // 2) ELSE nb - f - (s - s // 2) END AS INTEGER) AS len_b
        FROM cut2),
enc AS (SELECT conv_id, turn, len_a, len_b,
               list_concat([2], a[1:len_a], [3], b[1:len_b], [3],
                           list_transform(range({max_length} - len_a - len_b - 3), lambda i: 0)) AS input_ids
        FROM fin)
SELECT conv_id, turn, len_a, len_b, CAST(list_sum(input_ids) AS BIGINT) AS id_sum,
       CAST(len_a + len_b + 3 AS INTEGER) AS mask_sum, array_to_string(input_ids, ',') AS ids
FROM enc"""


ORACLE["encode_pairs"] = _encode_sql(K.MAX_LENGTH)
ORACLE["encode_pairs_cut"] = _encode_sql(64)


def _examples_sql(max_length: int) -> str:
    budget = max_length - 3
    ctes = f"""{AREA_CTE},
{QA_CTE},
ctx AS (SELECT img_name, string_agg(CAST(value AS VARCHAR), ' ' ORDER BY grid_ord, class_ord) AS t FROM area GROUP BY img_name),
corpus AS (SELECT question AS t FROM qa UNION ALL SELECT t FROM ctx),
toks AS (SELECT unnest(string_split(t, ' ')) AS token FROM corpus),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY count(*) DESC, token) - 1 + 4 AS INTEGER) AS id
          FROM toks GROUP BY token),
cpos AS (SELECT img_name, unnest(string_split(t, ' ')) AS token, generate_subscripts(string_split(t, ' '), 1) AS p FROM ctx),
cids AS (SELECT img_name, list(v.id ORDER BY p) AS b FROM cpos JOIN vocab v USING (token) GROUP BY img_name),
qpos AS (SELECT index, unnest(string_split(question, ' ')) AS token, generate_subscripts(string_split(question, ' '), 1) AS p FROM qa),
qids AS (SELECT index, list(v.id ORDER BY p) AS a FROM qpos JOIN vocab v USING (token) GROUP BY index),
lab AS (SELECT index, question_type, img_name, coalesce(ords, []) AS ords,
               list_transform(list_distinct(flatten(grid_coordinates)),
                   lambda t: ((coalesce(list_position({CELLS_LIST}, t) - 1, -1) % 16) + 16) % 16) AS pids FROM qa),
j AS (SELECT l.index, l.question_type,
             array_to_string(list_transform(range(335), lambda i: CASE WHEN list_contains(l.ords, i) THEN '1' ELSE '0' END), '') AS answ_bits,
             array_to_string(list_transform(range(16), lambda i: CASE WHEN list_contains(l.pids, i) THEN '1' ELSE '0' END), '') AS patch_bits,
             qi.a, coalesce(ci.b, []) AS b
      FROM lab l JOIN qids qi ON qi.index = l.index LEFT JOIN cids ci ON ci.img_name = l.img_name),
lens AS (SELECT *, CAST(len(a) AS INTEGER) AS na, CAST(len(b) AS INTEGER) AS nb FROM j),
cut AS (SELECT *, greatest(na + nb - {budget}, 0) AS r FROM lens),
cut2 AS (SELECT *, least(abs(na - nb), r) AS f, r - least(abs(na - nb), r) AS s FROM cut),
fin AS (SELECT *, CAST(CASE WHEN na > nb THEN na - f - s // 2 ELSE na - s // 2 END AS INTEGER) AS len_a,
                  CAST(CASE WHEN na > nb THEN nb - (s - s // 2) ELSE nb - f - (s - s // 2) END AS INTEGER) AS len_b
        FROM cut2)"""
    return with_(
        ctes,
        f"""SELECT index, question_type, len_a, len_b,
       array_to_string(list_concat([2], a[1:len_a], [3], b[1:len_b], [3], list_transform(range({max_length} - len_a - len_b - 3), lambda i: 0)), ',') AS ids,
       repeat('1', len_a + len_b + 3) || repeat('0', {max_length} - len_a - len_b - 3) AS mask, patch_bits, answ_bits
FROM fin""",
    )


ORACLE["vqa_examples"] = _examples_sql(K.MAX_LENGTH)

ORACLE["fit_heads"] = """SELECT 'y' || l.label AS label, (SELECT count(*) FROM embeddings) AS n, count(*) AS positives, true AS beats_prior
FROM embeddings l GROUP BY l.label"""


def _canonical_zero(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0.0)``: DuckDB keeps -0.0, Spark's decimal rounding gives 0.0."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len("round")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
            if depth == 0:
                break
        out.append(sql[i:j] + "(" + _canonical_zero(sql[j + len("round(") : k - 1]).join(["round(", ")"]) + " + 0.0)")
        i = k


ORACLE = {k: _canonical_zero(v) for k, v in ORACLE.items()}
