"""The registered queries as DuckDB SQL over the test tables.

``VIEWS`` holds named subqueries; a statement gets those it names, and those
they name, as a WITH clause in this order.
"""

from __future__ import annotations

import re

from bazarlens.fixed_values import (
    CATALOG_DESCRIPTION,
    CLASSIFY_PROMPT,
    HEADING_CATALOG,
    HEADING_PROFILE,
    HEADING_STATUS,
    PAIN_ORDER,
    PERSONAS,
    SIGNALS_PT,
    STOPWORDS_PT,
    TAXONOMY,
)
from bazarlens.operators.cluster import RESTARTS
from bazarlens.sources.proxies import PROXY_SIGNALS


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return ", ".join(_q(v) for v in values)


_SIGNAL_VALUES = ", ".join(f"({_q(c)}, {_q(s)}, {i})" for i, (c, words) in enumerate(PROXY_SIGNALS.items()) for s in words)
_DEFAULT_SIGNAL_VALUES = ", ".join(f"({_q(c)}, {_q(s)}, {i})" for i, (c, words) in enumerate(SIGNALS_PT.items()) for s in words)
_TAXONOMY_VALUES = ", ".join(f"({_q(c)}, {i})" for i, c in enumerate(TAXONOMY))
_PROMPT_HEAD, _PROMPT_TAIL = CLASSIFY_PROMPT.split("{comment}")
_PERSONA_VALUES = ", ".join(f"({_q(n)}, {_q(p['opening'])}, {_q(p['closing'])})" for n, p in PERSONAS.items())

ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñ"
PLAIN = "aaaaaeeeeiiiiooooouuuucn"


def _centers(rows: list[tuple[int, float, float]]) -> str:
    return "(VALUES " + ", ".join(f"({i}, {x}e0, {y}e0)" for i, x, y in rows) + ") c(cluster, cx, cy)"


_TWO = [(0, 0.0, 0.0), (1, 0.0, 1.5)]
_THREE = [(0, 0.0, 0.0), (1, 0.0, 1.5), (2, 1.5, 0.0)]


def _assign(source: str, centers: list[tuple[int, float, float]]) -> str:
    return f"""SELECT * FROM (
      SELECT s.*, CAST(c.cluster AS BIGINT) AS cluster,
             (s.recency_s - c.cx) * (s.recency_s - c.cx) + (s.monetary_s - c.cy) * (s.monetary_s - c.cy) AS dist2
      FROM {source} s, {_centers(centers)})
    QUALIFY row_number() OVER (PARTITION BY customer_unique_id ORDER BY dist2, cluster) = 1"""


def _scale(where: str) -> str:
    return f"""SELECT r.*, (recency - rm) / (CASE WHEN rq = 0 THEN 1 ELSE rq END) AS recency_s,
             (monetary - mm) / (CASE WHEN mq = 0 THEN 1 ELSE mq END) AS monetary_s
      FROM rfm_t r, (SELECT quantile_cont(CAST(recency AS DOUBLE), 0.5) rm,
                          quantile_cont(CAST(recency AS DOUBLE), 0.75) - quantile_cont(CAST(recency AS DOUBLE), 0.25) rq,
                          quantile_cont(monetary, 0.5) mm,
                          quantile_cont(monetary, 0.75) - quantile_cont(monetary, 0.25) mq
                   FROM rfm_t WHERE {where}) WHERE {where}"""


def _tokens(column: str) -> str:
    """Cleaned tokens of a text column."""
    return f"""list_filter(string_split_regex(regexp_replace(regexp_replace(lower({column}), '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]', ' ', 'g'), '\\p{{Nd}}+', '', 'g'), '[\\s\\p{{Z}}]+'),
        lambda x: length(x) > 2 AND NOT list_contains([{_list(STOPWORDS_PT)}], x))"""


def _silhouette_rows(assigned: str, by: str) -> str:
    """Silhouette and size per ``by``, from all pairs with Euclidean distances."""
    return f"""SELECT {by}, avg(s) AS silhouette, count(*) AS n FROM (
      SELECT {by}, id, CASE WHEN max(own_n) = 1 OR greatest(max(a), min(b)) = 0 THEN 0
                      ELSE (min(b) - max(a)) / greatest(max(a), min(b)) END AS s FROM (
        SELECT {by}, id, max(CASE WHEN cluster = ocluster THEN on_n END) AS own_n,
               CASE WHEN cluster = ocluster AND on_n > 1 THEN sum(d) / (on_n - 1) END AS a,
               CASE WHEN cluster <> ocluster THEN sum(d) / on_n END AS b
        FROM (SELECT p.{by}, p.customer_unique_id AS id, p.cluster, o.cluster AS ocluster,
                     sqrt((p.recency_s - o.recency_s) ** 2 + (p.monetary_s - o.monetary_s) ** 2) AS d
              FROM {assigned} p JOIN {assigned} o ON p.{by} = o.{by}) p
        JOIN (SELECT {by}, cluster AS ocluster, count(*) AS on_n FROM {assigned} GROUP BY ALL) o USING ({by}, ocluster)
        GROUP BY {by}, id, cluster, ocluster, on_n) GROUP BY {by}, id) GROUP BY {by}"""


def _silhouette(assigned: str, k: int) -> str:
    rows = _silhouette_rows(f"(SELECT *, CAST({k} AS BIGINT) AS k FROM {assigned})", "k")
    return f"SELECT k, round(silhouette, 6) AS silhouette, n FROM ({rows})"


def _fits(group: str, points: str, ks: str) -> dict[str, str]:
    """k-means of a group as views: farthest-first starts, updates until nothing moves, best restart, labels, scores."""
    gap = "(x - cx[i]) ** 2 + (y - cy[i]) ** 2"
    return {
        f"{group}_points": f"SELECT customer_unique_id AS id, recency_s AS x, monetary_s AS y FROM {points}",
        f"{group}_starts": f"""SELECT run, 1 AS n, [arg_min(x, (md5(concat(id, ':', 42 + run)), id))] AS cx, [arg_min(y, (md5(concat(id, ':', 42 + run)), id))] AS cy
      FROM {group}_points, range({RESTARTS}) r(run) GROUP BY run
      UNION ALL
      SELECT run, n + 1, list_append(cx, arg_max(x, (gap, -id))), list_append(cy, arg_max(y, (gap, -id))) FROM (
        SELECT run, n, cx, cy, id, x, y, list_min(list_transform(range(1, n + 1), lambda i: {gap})) AS gap
        FROM {group}_starts, {group}_points WHERE n < {max(map(int, ks.split(",")))}) GROUP BY run, n, cx, cy""",
        f"{group}_moves": f"""SELECT run, n AS k, cx, cy, FALSE AS still FROM {group}_starts WHERE n IN ({ks})
      UNION ALL
      SELECT run, k, nx, ny, list_max(list_transform(range(1, k + 1), lambda i: greatest(abs(nx[i] - cx[i]), abs(ny[i] - cy[i])))) <= 1e-9 FROM (
        SELECT run, k, cx, cy, list_transform(range(1, k + 1), lambda i: coalesce(list_extract(list_transform(list_filter(means, lambda m: m.c = i), lambda m: m.x), 1), cx[i])) AS nx,
               list_transform(range(1, k + 1), lambda i: coalesce(list_extract(list_transform(list_filter(means, lambda m: m.c = i), lambda m: m.y), 1), cy[i])) AS ny
        FROM (SELECT run, k, cx, cy, list({{'c': c, 'x': mx, 'y': my}}) AS means FROM (
          SELECT run, k, cx, cy, c, avg(x) AS mx, avg(y) AS my FROM (
            SELECT run, k, cx, cy, x, y, list_position(gaps, list_min(gaps)) AS c FROM (
              SELECT run, k, cx, cy, x, y, list_transform(range(1, k + 1), lambda i: {gap}) AS gaps
              FROM {group}_moves, {group}_points WHERE NOT still)) GROUP BY run, k, cx, cy, c) GROUP BY run, k, cx, cy))""",
        f"{group}_best": f"""SELECT k, arg_min(cx, (cost, run)) AS cx, arg_min(cy, (cost, run)) AS cy FROM (
        SELECT run, k, cx, cy, sum(list_min(list_transform(range(1, k + 1), lambda i: {gap}))) AS cost
        FROM {group}_moves, {group}_points WHERE still GROUP BY run, k, cx, cy) GROUP BY k""",
        f"{group}_centres": f"""SELECT k, row_number() OVER (PARTITION BY k ORDER BY cx, cy) - 1 AS cluster, cx, cy
      FROM (SELECT k, unnest(cx) AS cx, unnest(cy) AS cy FROM {group}_best)""",
        f"{group}_labels": f"""SELECT p.*, k, cluster FROM {points} p, {group}_centres
      QUALIFY row_number() OVER (PARTITION BY k, customer_unique_id ORDER BY (recency_s - cx) * (recency_s - cx) + (monetary_s - cy) * (monetary_s - cy), cluster) = 1""",
        f"{group}_scores": _silhouette_rows(f"{group}_labels", "k"),
        f"{group}_chosen": f"SELECT * FROM {group}_labels WHERE k = (SELECT arg_max(k, (silhouette, -k)) FROM {group}_scores)",
    }


VIEWS: dict[str, str] = {
    # --- proxy tables
    "orders_p": """SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_purchase_timestamp,
      CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'processing' END AS order_status FROM orders""",
    "items_p": "SELECT l_orderkey AS order_id, l_partkey AS product_id, l_extendedprice AS price, l_tax AS freight_value FROM lineitem",
    "products_p": "SELECT p_partkey AS product_id, NULLIF(p_brand, 'Brand#7') AS product_category_name FROM part",
    "translation_p": """SELECT DISTINCT p_brand AS product_category_name, CONCAT('en_', LOWER(p_brand)) AS product_category_name_english
      FROM part WHERE p_brand NOT LIKE '%5' AND p_brand <> 'Brand#7'""",
    "reviews_p": """SELECT d.doc_id AS review_id, d.doc_id AS order_id, d.text AS review_comment_message,
      CASE WHEN l.toxic = 1 THEN 1 WHEN l.quality = 0 THEN 2 WHEN l.quality = 1 THEN 5 END AS review_score
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "customers_p": """SELECT c_custkey AS customer_id, c_custkey AS customer_unique_id, n_name AS customer_city,
      r_name AS customer_state, c_custkey % 97 AS customer_zip_code_prefix
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "geolocation_p": """SELECT c_custkey % 97 AS geolocation_zip_code_prefix,
      CASE WHEN c_custkey % 97 = 50 THEN 40.0e0 ELSE -24.0e0 + (c_custkey * 31 % 1000) / 1000.0e0 END AS geolocation_lat,
      -47.0e0 + (c_custkey * 17 % 1000) / 1000.0e0 AS geolocation_lng
      FROM customer WHERE c_custkey % 97 NOT IN (89, 93, 96)""",
    "sellers_p": "SELECT s_suppkey AS seller_id, n_name AS seller_city FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "events_p": """SELECT event_id, ts, user_id AS customer_id, event_type,
      CAST(json_extract(props, '$.k') AS BIGINT) AS product_id FROM events""",
    # --- sales
    "delivered": "SELECT * FROM orders_p WHERE order_status = 'delivered'",
    "categories": """SELECT product_id, coalesce(product_category_name_english, product_category_name, 'unknown_category') AS categoria
      FROM products_p LEFT JOIN translation_p USING (product_category_name)""",
    "sales_items": """SELECT order_id, customer_id, product_id, price, categoria
      FROM delivered JOIN items_p USING (order_id) JOIN categories USING (product_id)""",
    "category_sales": """SELECT categoria, count(*) AS units, sum(price) AS revenue, avg(price) AS avg_price,
      min(price) AS min_price, max(price) AS max_price FROM sales_items GROUP BY categoria""",
    "order_revenue_t": "SELECT order_id, sum(price) AS ingresos FROM items_p GROUP BY order_id",
    "order_rows": """SELECT order_id, customer_id, order_purchase_timestamp, ingresos, customer_unique_id, customer_city,
      customer_state, customer_zip_code_prefix
      FROM delivered JOIN order_revenue_t USING (order_id) JOIN customers_p USING (customer_id)""",
    # --- reviews
    "corpus": "SELECT * FROM reviews_p WHERE review_score IN (1, 2) AND review_comment_message IS NOT NULL",
    "signal_list": f"SELECT * FROM (VALUES {_SIGNAL_VALUES}) t(categoria, senal, pos)",
    "default_signals": f"SELECT * FROM (VALUES {_DEFAULT_SIGNAL_VALUES}) t(categoria, senal, pos)",
    "padded": f"""SELECT review_id, order_id, review_score, review_comment_message, concat(' ', regexp_replace(regexp_replace(
        translate(lower(review_comment_message), '{ACCENTED}', '{PLAIN}'), '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]', ' ', 'g'),
        '[\\s\\p{{Z}}]+', ' ', 'g'), ' ') AS t FROM corpus""",
    "signal_hits": """SELECT review_id, categoria, pos, count(*) AS n_senales
      FROM padded JOIN signal_list ON contains(t, ' ' || senal || ' ') GROUP BY review_id, categoria, pos""",
    "classified": """SELECT c.*, coalesce(h.categoria, 'Otro') AS pain_point_category FROM corpus c
      LEFT JOIN (SELECT review_id, arg_min(categoria, pos) AS categoria FROM signal_hits GROUP BY review_id) h USING (review_id)""",
    "review_cats": """SELECT r.review_id, r.order_id, r.review_score, i.product_id, coalesce(c.categoria, 'unknown_category') AS categoria
      FROM reviews_p r JOIN items_p i ON r.order_id = i.order_id LEFT JOIN categories c ON i.product_id = c.product_id""",
    "bad_cats": """SELECT r.review_id, r.pain_point_category AS pain, coalesce(c.categoria, 'unknown_category') AS categoria
      FROM classified r JOIN items_p i ON r.order_id = i.order_id LEFT JOIN categories c ON i.product_id = c.product_id""",
    "totals": "SELECT categoria, count(review_id) AS total_resenas FROM review_cats GROUP BY categoria",
    "rates": """SELECT categoria, total_resenas, coalesce(b.n, 0) AS resenas_negativas,
      coalesce(b.n, 0) * 100e0 / total_resenas AS tasa FROM totals
      LEFT JOIN (SELECT categoria, count(review_id) AS n FROM bad_cats GROUP BY categoria) b USING (categoria)""",
    "pain_rates": """SELECT categoria, pain, total_resenas, b.n AS resenas_negativas_pain, b.n * 100e0 / total_resenas AS tasa
      FROM totals JOIN (SELECT categoria, pain, count(review_id) AS n FROM bad_cats GROUP BY categoria, pain) b USING (categoria)
      WHERE total_resenas >= 20""",
    "pain_top": f"""SELECT *, row_number() OVER (PARTITION BY pain ORDER BY round_even(tasa, 1) DESC, categoria) AS posicion
      FROM pain_rates WHERE pain IN ({_list(PAIN_ORDER)}) QUALIFY posicion <= 5""",
    # --- text
    "clean_tokens": f"SELECT review_id, review_score, review_comment_message, {_tokens('review_comment_message')} AS tokens FROM reviews_p",
    "cleaned": "SELECT review_id, review_score, review_comment_message, array_to_string(tokens, ' ') AS limpio FROM clean_tokens",
    "terms": """SELECT review_id, 1 AS n, unnest(tokens) AS term FROM clean_tokens
      UNION ALL SELECT review_id, 2, unnest(list_transform(range(1, len(tokens)), lambda i: array_to_string(tokens[i:i+1], ' '))) FROM clean_tokens
      UNION ALL SELECT review_id, 3, unnest(list_transform(range(1, len(tokens) - 1), lambda i: array_to_string(tokens[i:i+2], ' '))) FROM clean_tokens""",
    "ngrams_t": """SELECT CAST(n AS BIGINT) AS n, term, count(*) AS freq, count(DISTINCT review_id) AS doc_freq
      FROM terms GROUP BY n, term HAVING count(DISTINCT review_id) >= 3""",
    # --- customers
    "rfm_t": """SELECT customer_unique_id, CAST(floor(date_diff('microsecond', max(order_purchase_timestamp), any_value(ref)) / 86400000000) AS BIGINT) AS recency,
      count(order_id) AS frequency, sum(ingresos) AS monetary
      FROM order_rows, (SELECT max(order_purchase_timestamp) + INTERVAL 1 DAY AS ref FROM delivered) GROUP BY customer_unique_id""",
    "scaled_rec": _scale("frequency >= 2"),
    "scaled_uni": _scale("frequency = 1"),
    "scaled_all": _scale("TRUE"),
    "rec2": _assign("scaled_rec", _TWO),
    "rec3": _assign("scaled_rec", _THREE),
    "uni2": _assign("scaled_uni", _TWO),
    "rec_labels": """SELECT cluster, CASE WHEN row_number() OVER (ORDER BY r DESC, cluster) = 1 AND k = 2 THEN 'Cliente_Fiel_En_Riesgo'
        WHEN row_number() OVER (ORDER BY r, cluster) = 1 THEN 'Cliente_Fiel_Activo' END AS segmento
      FROM (SELECT cluster, avg(recency) AS r, count(*) OVER () AS k FROM rec2 GROUP BY cluster)""",
    "uni_labels": """SELECT cluster, CASE WHEN row_number() OVER (ORDER BY m, cluster) = 1 THEN 'Esporadico_Comun'
        WHEN row_number() OVER (ORDER BY m DESC, cluster) = 1 THEN 'Alto_Valor_Durmiente' END AS segmento
      FROM (SELECT cluster, avg(monetary) AS m FROM uni2 GROUP BY cluster)""",
    "segmented": """SELECT customer_unique_id, recency, frequency, monetary, segmento FROM rec2 LEFT JOIN rec_labels USING (cluster)
      UNION ALL SELECT customer_unique_id, recency, frequency, monetary, segmento FROM uni2 LEFT JOIN uni_labels USING (cluster)""",
    "sil2": _silhouette("rec2", 2),
    "sil3": _silhouette("rec3", 3),
    **_fits("recfit", "scaled_rec", "2, 3, 4, 5"),
    **_fits("unifit", "scaled_uni", "2, 3, 4, 5, 6"),
    "recfit_names": """SELECT cluster, CASE WHEN k = 2 AND from_end = 1 THEN 'Cliente_Fiel_En_Riesgo' WHEN pos = 1 THEN 'Cliente_Fiel_Activo'
        WHEN k > 2 AND pos = 2 THEN 'Cliente_Fiel_Intermedio' WHEN k > 2 AND pos = 3 THEN 'Cliente_Fiel_En_Riesgo' END AS segmento
      FROM (SELECT cluster, count(*) OVER () AS k, row_number() OVER (ORDER BY avg(recency), cluster) AS pos,
              row_number() OVER (ORDER BY avg(recency) DESC, cluster) AS from_end FROM recfit_chosen GROUP BY cluster)""",
    "unifit_names": """SELECT cluster, CASE WHEN row_number() OVER (ORDER BY m, cluster) = 1 THEN 'Esporadico_Comun'
        WHEN row_number() OVER (ORDER BY m DESC, cluster) = 1 THEN 'Alto_Valor_Durmiente' END AS segmento
      FROM (SELECT cluster, avg(monetary) AS m FROM unifit_chosen GROUP BY cluster)""",
    # --- location
    "cities": """SELECT customer_city, customer_state, count(order_id) AS ordenes, sum(ingresos) AS ingresos_totales,
      count(DISTINCT customer_unique_id) AS clientes_unicos FROM order_rows GROUP BY customer_city, customer_state""",
    "best": "SELECT * FROM cities ORDER BY ingresos_totales DESC, customer_city, customer_state LIMIT 1",
    "zips": """SELECT geolocation_zip_code_prefix AS zip, avg(geolocation_lat) AS lat, avg(geolocation_lng) AS lng
      FROM geolocation_p GROUP BY 1""",
    "geo_rows": """SELECT o.*, lat, lng FROM order_rows o JOIN zips ON customer_zip_code_prefix = zip
      WHERE lat BETWEEN -34 AND 5 AND lng BETWEEN -74 AND -34""",
    "city_rows": "SELECT * FROM geo_rows WHERE customer_city = (SELECT customer_city FROM best)",
    "center": """SELECT sum(lat * ingresos) / sum(ingresos) AS lat_opt, sum(lng * ingresos) / sum(ingresos) AS lng_opt,
      avg(lat) AS lat_simple, avg(lng) AS lng_simple, count(*) AS n_orders, sum(ingresos) AS ingresos FROM city_rows""",
    "city_km": """SELECT sqrt(power((lat - lat_opt) * 111, 2) + power((lng - lng_opt) * 111 * cos(radians(lat_opt)), 2)) AS km
      FROM city_rows, (SELECT lat_opt, lng_opt FROM center)""",
    "city_geo_t": """SELECT customer_city, customer_state, sum(ingresos) AS ingresos, count(order_id) AS ordenes, avg(lat) AS lat, avg(lng) AS lng
      FROM geo_rows GROUP BY customer_city, customer_state""",
    # --- catalogue and context
    "featured": """SELECT categoria FROM (SELECT categoria, row_number() OVER (ORDER BY revenue DESC, categoria) AS rr,
        row_number() OVER (ORDER BY units DESC, categoria) AS ru FROM category_sales) ORDER BY least(rr, ru), rr, categoria LIMIT 3""",
    "products_t": """SELECT concat('PROD-', regexp_replace(categoria, '[^0-9]', '', 'g')) AS id, categoria,
      concat('Seleccion ', categoria) AS nombre, concat('Lo mejor de "', categoria, '"') AS descripcion,
      round(avg_price, 2) AS precio_promedio_real, min_price AS minimo, max_price AS maximo, units AS unidades_vendidas,
      length(categoria) % 2 = 0 AS destacado, [categoria, 'hogar', 'regalo'] AS tags
      FROM featured JOIN category_sales USING (categoria)""",
    "latest": """SELECT customer_unique_id, review_id, pain_point_category AS queja_categoria, review_comment_message AS queja_detalle
      FROM classified JOIN orders_p USING (order_id) JOIN customers_p USING (customer_id)
      QUALIFY row_number() OVER (PARTITION BY customer_unique_id ORDER BY order_purchase_timestamp DESC, review_id DESC) = 1""",
    "history": """SELECT customer_unique_id, concat(CASE WHEN frequency >= 2 THEN concat('cliente recurrente (', frequency, ' compras)')
        ELSE concat('comprador de primera vez (', frequency, ' compra)') END, ', gasto acumulado ',
        CASE WHEN monetary >= 400000 THEN 'alto' WHEN monetary >= 100000 THEN 'medio' ELSE 'bajo' END, ' de R$',
        CAST(round_even(round(monetary, 2), 0) AS BIGINT), ', inactivo hace ', recency, ' dias.') AS historial_compras,
        concat('Ultimo pedido hace ', recency, ' dias. ', CASE WHEN recency <= 365 THEN 'Hay un pedido reciente en el sistema.'
        ELSE 'Sin pedidos recientes en el sistema.' END) AS orden_status FROM rfm_t""",
    "profiles": """SELECT *, CASE WHEN queja_categoria IS NOT NULL OR segmento = 'Cliente_Fiel_En_Riesgo' THEN 'Marco'
        WHEN segmento = 'Alto_Valor_Durmiente' THEN 'VIP' ELSE 'Luna' END AS persona
      FROM segmented JOIN history USING (customer_unique_id) LEFT JOIN latest USING (customer_unique_id)""",
    "catalog_t": """SELECT concat('[', chr(10), string_agg(block, concat(',', chr(10)) ORDER BY id), chr(10), ']') AS catalogo FROM (
      SELECT id, concat('  {', chr(10), '    "id": ', to_json(id), ',', chr(10), '    "nombre": ', to_json(nombre), ',', chr(10),
        '    "categoria": ', to_json(categoria), ',', chr(10), '    "descripcion": ', to_json(descripcion), ',', chr(10),
        '    "precio_promedio_R$": ', precio_promedio_real, ',', chr(10), '    "rango_precios_R$": {', chr(10),
        '      "minimo": ', minimo, ',', chr(10), '      "maximo": ', maximo, chr(10), '    },', chr(10),
        '    "unidades_vendidas": ', unidades_vendidas, ',', chr(10), '    "tags": [', chr(10), '      ',
        array_to_string(list_transform(tags, lambda t: CAST(to_json(t) AS VARCHAR)), concat(',', chr(10), '      ')), chr(10), '    ]', chr(10), '  }') AS block
      FROM products_t)""",
    "prompts": f"""SELECT customer_unique_id, persona, concat(opening, chr(10), chr(10), {_q(HEADING_PROFILE)}, chr(10), '{{', chr(10),
        array_to_string(list_filter([
          CASE WHEN segmento IS NOT NULL THEN concat('  "segmento_crm": ', to_json(segmento)) END,
          concat('  "historial_compras": ', to_json(historial_compras)),
          CASE WHEN queja_categoria IS NOT NULL THEN concat('  "experiencia_negativa_previa": {{', chr(10), '    "categoria": ',
            to_json(queja_categoria), ',', chr(10), '    "detalle_original": ', to_json(queja_detalle), chr(10), '  }}') END
        ], lambda x: x IS NOT NULL), concat(',', chr(10))), chr(10), '}}', chr(10), chr(10), {_q(HEADING_CATALOG)}, chr(10), catalogo, chr(10), chr(10),
        {_q(HEADING_STATUS)}, chr(10), orden_status, chr(10), chr(10), closing) AS prompt
      FROM profiles JOIN (VALUES {_PERSONA_VALUES}) p(persona, opening, closing) USING (persona), catalog_t""",
    # --- recommendations
    "bought": """SELECT customer_unique_id AS customer, product_id AS product, count(*) AS units, sum(price) AS spend
      FROM delivered JOIN items_p USING (order_id) JOIN customers_p USING (customer_id) GROUP BY 1, 2""",
    "buyer_segments": """SELECT customer_unique_id AS customer, CASE WHEN frequency >= 2 THEN 'recurrente' ELSE 'unico' END AS segmento FROM rfm_t""",
    "popular": "SELECT product, count(*) AS buyers, sum(units) AS units, sum(spend) AS revenue FROM bought GROUP BY product",
    "popular_seg": """SELECT segmento, product, count(*) AS buyers, sum(units) AS units, sum(spend) AS revenue
      FROM bought JOIN buyer_segments USING (customer) GROUP BY segmento, product""",
    "ratings": """SELECT product_id AS product, avg(review_score) AS rating FROM reviews_p JOIN items_p USING (order_id) GROUP BY 1""",
    "pool_rated": """SELECT segmento, product, round_even((units / max(units) OVER s + revenue / max(revenue) OVER s
        + coalesce(rating / max(rating) OVER s, 0)) / 3, 6) AS score
      FROM popular_seg LEFT JOIN ratings USING (product) WINDOW s AS (PARTITION BY segmento)""",
    "pool_plain": """SELECT segmento, product, round_even((units / max(units) OVER s + revenue / max(revenue) OVER s) / 3, 6) AS score
      FROM popular_seg WINDOW s AS (PARTITION BY segmento)""",
    "pairs": """SELECT a.product AS product_a, b.product AS product_b, count(*) AS n_customers
      FROM bought a JOIN bought b ON a.customer = b.customer AND a.product < b.product GROUP BY 1, 2""",
    "similar_t": """SELECT product_a, product_b, n_customers / sqrt(a.buyers * CAST(b.buyers AS DOUBLE)) AS similarity
      FROM pairs JOIN popular a ON a.product = product_a JOIN popular b ON b.product = product_b""",
    "similar_both": """SELECT product_a AS product, product_b AS neighbour, similarity FROM similar_t
      UNION ALL SELECT product_b, product_a, similarity FROM similar_t""",
    "pool_top": "SELECT segmento, product FROM pool_plain QUALIFY row_number() OVER (PARTITION BY segmento ORDER BY score DESC, product) <= 100",
    "implicit_t": """SELECT customer_id, product_id, sum(CASE event_type WHEN 'purchase' THEN 1.0e0 WHEN 'click' THEN 0.3e0 ELSE 0.1e0 END) AS score
      FROM events_p WHERE event_type IN ('purchase', 'click', 'view') GROUP BY 1, 2""",
    "cf_signals": """SELECT customer, neighbour AS product, similarity AS signal
      FROM bought JOIN similar_both USING (product) JOIN buyer_segments USING (customer)
      JOIN pool_top ON pool_top.segmento = buyer_segments.segmento AND pool_top.product = neighbour
      UNION ALL
      SELECT customer_id, product_id, implicit_t.score * 0.01e0 FROM implicit_t JOIN buyer_segments ON customer = customer_id
      JOIN pool_top ON pool_top.segmento = buyer_segments.segmento AND pool_top.product = product_id""",
    "cf_ranked": """SELECT customer, product, score, row_number() OVER (PARTITION BY customer ORDER BY score DESC, product) AS rank
      FROM (SELECT customer, product, round_even(sum(signal), 6) AS score FROM cf_signals GROUP BY 1, 2)
      ANTI JOIN bought USING (customer, product) QUALIFY rank <= 10""",
    "features": """SELECT p_partkey AS product, p_brand AS categoria, p_retailprice AS price,
      row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS place FROM part""",
    "content": """SELECT a.product, a.categoria, b.product AS neighbour, abs(b.price - a.price) AS price_gap,
        row_number() OVER (PARTITION BY a.product ORDER BY abs(b.price - a.price), abs(a.place - b.place), b.product) AS rank
      FROM features a JOIN features b ON a.categoria = b.categoria AND a.product <> b.product QUALIFY rank <= 5""",
    "routes": """SELECT customer_unique_id AS customer, coalesce(n, 0) AS n_products,
        CASE WHEN coalesce(n, 0) >= 3 THEN 'item_cf' WHEN coalesce(n, 0) >= 1 THEN 'content' ELSE 'popular' END AS route
      FROM customers_p LEFT JOIN (SELECT customer AS customer_unique_id, count(*) AS n FROM bought GROUP BY 1) USING (customer_unique_id)""",
    # --- behaviour
    "served": "SELECT event_id AS served_id, customer_id, product_id, ts FROM events_p WHERE event_type = 'view'",
    "actions": "SELECT event_id AS action_id, customer_id, product_id, ts, event_type AS action FROM events_p WHERE event_type IN ('click', 'purchase')",
    "scores": """SELECT customer_id, product_id,
        round(sum(CASE event_type WHEN 'purchase' THEN 1.0e0 WHEN 'click' THEN 0.3e0 ELSE 0.1e0 END), 4) AS score, count(*) AS n_events
      FROM events_p WHERE event_type IN ('purchase', 'click', 'view') GROUP BY 1, 2""",
    "visits": """SELECT customer_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events FROM (
        SELECT *, sum(new) OVER (PARTITION BY customer_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS visit FROM (
          SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY customer_id ORDER BY ts, event_id) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new
          FROM events_p)) GROUP BY customer_id, visit""",
}

_COLS = "%Y-%m-%d %H:%M:%S"


def _feedback(seconds: int) -> str:
    return f"""SELECT s.served_id, s.customer_id, s.product_id, arg_min(a.action, (a.ts, a.action_id)) AS action,
      date_diff('microsecond', any_value(s.ts), min(a.ts)) / 1000000e0 AS delay_seconds
      FROM served s LEFT JOIN actions a ON s.customer_id = a.customer_id AND s.product_id = a.product_id
        AND a.ts > s.ts AND a.ts <= s.ts + INTERVAL {seconds} SECOND
      GROUP BY s.served_id, s.customer_id, s.product_id"""


def _signal_stats(signals: str) -> str:
    return f"""SELECT categoria, CASE len(string_split(senal, ' ')) WHEN 1 THEN 'unigrama' WHEN 2 THEN 'bigrama' ELSE 'trigrama' END AS tipo,
      count(*) AS n_senales, CAST(sum(n) AS BIGINT) AS n_textos FROM (SELECT categoria, senal, count(review_id) AS n
        FROM {signals} LEFT JOIN padded ON contains(t, ' ' || senal || ' ') GROUP BY categoria, senal) GROUP BY 1, 2"""


def _metrics(seconds: int) -> str:
    return f"""SELECT count(*) AS n_served, round(count(action) * 100e0 / count(*), 6) AS ctr_pct,
      round(count(*) FILTER (WHERE action = 'purchase') * 100e0 / count(*), 6) AS conversion_pct, count(DISTINCT product_id) AS n_products,
      round(count(DISTINCT product_id) * 100e0 / (SELECT count(DISTINCT product_id) FROM products_p), 6) AS coverage_pct FROM ({_feedback(seconds)})"""


def _profile(table: str, view: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null FROM {view}" for c in columns
    )


def _describe(column: str) -> str:
    v = f"CAST({column} AS DOUBLE)"
    return f"""SELECT '{column}' AS column_name, count(*) AS n, round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS std, round(min({v}), 4) AS min,
      round(quantile_cont({v}, 0.25), 4) AS p25, round(quantile_cont({v}, 0.5), 4) AS p50, round(quantile_cont({v}, 0.75), 4) AS p75,
      round(max({v}), 4) AS max FROM rfm_t"""


BODIES: dict[str, str] = {
    # --- sources, sinks, profiles
    "scan_csv": "SELECT review_id, order_id, review_score, md5(review_comment_message) AS text_md5 FROM reviews_p",
    "load_tables": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS n_rows, CAST({n} AS BIGINT) AS n_columns FROM {view}"
        for name, view, n in [
            ("orders", "orders_p", 4), ("items", "items_p", 4), ("products", "products_p", 2), ("translation", "translation_p", 2),
            ("reviews", "reviews_p", 4), ("customers", "customers_p", 5), ("geolocation", "geolocation_p", 3), ("sellers", "sellers_p", 2),
        ]
    ),
    "profile_table": " UNION ALL ".join([
        _profile("orders", "orders_p", ["order_id", "customer_id", "order_purchase_timestamp", "order_status"]),
        _profile("products", "products_p", ["product_id", "product_category_name"]),
        _profile("reviews", "reviews_p", ["review_id", "order_id", "review_comment_message", "review_score"]),
        _profile("sellers", "sellers_p", ["seller_id", "seller_city"]),
    ]),
    "describe_numeric": " UNION ALL ".join(_describe(c) for c in ("recency", "frequency", "monetary")),
    "value_counts": "SELECT order_status, count(*) AS n FROM orders_p GROUP BY order_status",
    "sink_table": "SELECT customer_unique_id, recency, frequency, round(monetary, 2) AS monetary, segmento FROM segmented",
    "sink_json_doc": """SELECT '1.0' AS version, count(*) AS total_productos, arg_min(id, id) AS first_id, arg_min(minimo, id) AS first_min,
      arg_min(tags[2], id) AS first_tag FROM products_t""",
    "scan_json_doc": """SELECT id, categoria, nombre, descripcion, precio_promedio_real, minimo, maximo, unidades_vendidas, destacado,
      array_to_string(tags, '|') AS tags FROM products_t""",
    "classify_resume": "SELECT review_id, review_score, pain_point_category FROM classified",
    # --- scalars
    "filter_delivered": f"SELECT order_id, customer_id, strftime(order_purchase_timestamp, '{_COLS}') AS purchased_at FROM delivered",
    "filter_bad_reviews": "SELECT review_id, order_id, review_score, length(review_comment_message) AS n_chars FROM corpus",
    "project_columns": "SELECT order_id, product_id FROM items_p",
    "category_fallback": "SELECT product_id, categoria FROM categories",
    "fill_zero_int": """SELECT order_id, coalesce(n, 0) AS n_bad FROM orders_p
      LEFT JOIN (SELECT order_id, count(review_id) AS n FROM corpus GROUP BY order_id) USING (order_id)""",
    "parse_timestamp": f"""SELECT order_id, strftime(order_purchase_timestamp, '{_COLS}') AS text,
      strftime(order_purchase_timestamp + INTERVAL 1 DAY, '{_COLS}') AS next_day FROM orders_p""",
    "recency_days": """SELECT event_id, CAST(floor(date_diff('microsecond', ts, (SELECT max(ts) + INTERVAL 1 DAY FROM events_p)) / 86400000000) AS BIGINT)
      AS recency FROM events_p""",
    "pct_rate": "SELECT order_status, round(count(*) * 100e0 / sum(count(*)) OVER (), 6) AS pct FROM orders_p GROUP BY order_status",
    "map_labels": "SELECT customer_unique_id, cluster, segmento FROM rec2 LEFT JOIN rec_labels USING (cluster)",
    "clean_text": "SELECT review_id, length(limpio) AS n_chars, md5(limpio) AS clean_md5 FROM cleaned",
    "text_length_rank": """SELECT review_id, length(limpio) AS n_chars, substring(review_comment_message, 1, 120) AS original,
      substring(limpio, 1, 120) AS limpio FROM cleaned WHERE review_score IN (1, 2) ORDER BY 2 DESC, 1 LIMIT 3""",
    "truncate_text": "SELECT review_id, substring(review_comment_message, 1, 100) AS first_100, substring(review_comment_message, 1, 120) AS first_120 FROM reviews_p",
    "parse_label": f"""SELECT review_id, coalesce((SELECT arg_min(l, p) FROM (VALUES {_TAXONOMY_VALUES}) t(l, p) WHERE contains(lower(answer), lower(l))), 'Otro') AS label
      FROM (SELECT review_id, concat(review_comment_message, ' -> ',
        CASE WHEN review_id % 3 = 0 THEN '??' ELSE upper(pain_point_category) END) AS answer FROM classified)""",
    "render_classify_prompt": f"""SELECT review_id, length(p) AS n_chars, md5(p) AS prompt_md5 FROM (SELECT review_id,
      concat({_q(_PROMPT_HEAD)}, regexp_replace(review_comment_message, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), {_q(_PROMPT_TAIL)}) AS p FROM corpus)""",
    "signal_match": "SELECT review_id, categoria, n_senales FROM signal_hits",
    "signal_stats": _signal_stats("signal_list"),
    "signal_stats_default": _signal_stats("default_signals"),
    "geo_bounds": """SELECT geolocation_zip_code_prefix, count(*) AS n,
      count(*) FILTER (WHERE geolocation_lat BETWEEN -34 AND 5 AND geolocation_lng BETWEEN -74 AND -34) AS n_valid FROM geolocation_p GROUP BY 1""",
    "planar_km": """SELECT zip, round(sqrt(power((lat + 23.5e0) * 111, 2) + power((lng + 46.6e0) * 111 * cos(radians(-23.5e0)), 2)), 6) AS km FROM zips""",
    "circle_radius": """SELECT customer_city, customer_state, round(ingresos, 2) AS ingresos,
      round(8000 + ingresos / (SELECT max(ingresos) FROM city_geo_t) * 55000, 4) AS radio_m,
      customer_city = (SELECT customer_city FROM best) AS es_top FROM city_geo_t ORDER BY ingresos DESC, customer_city, customer_state LIMIT 20""",
    "title_case": """SELECT array_to_string(list_transform(string_split(lower(customer_city), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title,
      upper(customer_city) AS upper, count(*) AS n FROM customers_p GROUP BY 1, 2""",
    "history_text": "SELECT customer_unique_id, historial_compras FROM history",
    "order_status_text": "SELECT customer_unique_id, orden_status FROM history",
    "scenario_route": "SELECT customer_unique_id, persona FROM profiles",
    "profile_json": """SELECT customer_unique_id, segmento AS segmento_crm, historial_compras, queja_categoria AS queja, md5(queja_detalle) AS detalle_md5,
      queja_categoria IS NOT NULL AS has_complaint FROM profiles""",
    "render_context": "SELECT customer_unique_id, persona, length(prompt) AS n_chars, md5(prompt) AS prompt_md5 FROM prompts",
    "catalog_filter": """SELECT id, categoria, precio_promedio_real FROM products_t
      WHERE list_contains(tags, 'hogar') AND precio_promedio_real BETWEEN 1000 AND 1000000 AND destacado""",
    # --- joins
    "join_sales_items": "SELECT order_id, customer_id, product_id, price, categoria FROM sales_items",
    "join_reviews_items": "SELECT product_id, review_id, order_id, review_score, categoria FROM review_cats",
    "join_order_revenue": "SELECT order_id, customer_unique_id, round(ingresos, 2) AS ingresos FROM order_rows",
    "join_rate": "SELECT categoria, total_resenas, resenas_negativas FROM rates",
    "join_pain_rate": "SELECT categoria, pain, total_resenas, resenas_negativas_pain, round(tasa, 6) AS tasa FROM pain_rates",
    "join_geo": "SELECT order_id, customer_zip_code_prefix, round(ingresos, 2) AS ingresos, round(lat, 9) AS lat, round(lng, 9) AS lng FROM geo_rows",
    "anti_done": "SELECT review_id, review_score FROM corpus WHERE review_id NOT IN (SELECT review_id FROM corpus WHERE review_score = 1)",
    "exclude_purchased": """SELECT customer, segmento, count(*) AS n_candidates, CAST(sum(rank) AS BIGINT) AS rank_sum FROM buyer_segments JOIN (
        SELECT *, row_number() OVER (PARTITION BY segmento ORDER BY score DESC, product) AS rank FROM pool_plain QUALIFY rank <= 50) USING (segmento)
      ANTI JOIN bought USING (customer, product) GROUP BY customer, segmento""",
    "customer_complaint": "SELECT customer_unique_id, review_id, queja_categoria, md5(queja_detalle) AS detalle_md5 FROM latest",
    "feedback_join": f"SELECT served_id, customer_id, product_id, action, round(delay_seconds, 6) AS delay_seconds FROM ({_feedback(86400)})",
    # --- aggregations
    "order_revenue": "SELECT order_id, round(ingresos, 2) AS revenue FROM order_revenue_t",
    "reviews_by_category": "SELECT categoria, total_resenas FROM totals",
    "bad_reviews_by_category": "SELECT categoria, count(review_id) AS resenas_negativas FROM bad_cats GROUP BY categoria",
    "dissatisfaction_rate": "SELECT categoria, total_resenas, resenas_negativas, round(tasa, 6) AS tasa_insatisfaccion FROM rates WHERE total_resenas >= 20",
    "pain_distribution": """SELECT pain_point_category, count(*) AS quejas, round(count(*) * 100e0 / sum(count(*)) OVER (), 6) AS pct
      FROM classified GROUP BY pain_point_category""",
    "combined_share": """SELECT count(*) AS n_quejas, round(count(*) FILTER (WHERE pain_point_category = 'Logistica_Retrasos') * 100e0 / count(*), 6) AS pct_1,
      round(count(*) FILTER (WHERE pain_point_category = 'Producto_Incorrecto_Faltante') * 100e0 / count(*), 6) AS pct_2,
      round(count(*) FILTER (WHERE pain_point_category IN ('Logistica_Retrasos', 'Producto_Incorrecto_Faltante')) * 100e0 / count(*), 6) AS pct_combined
      FROM classified""",
    "eligible_counts": "SELECT count(*) FILTER (WHERE total_resenas >= 20) AS n_eligible, count(*) AS n_total FROM rates",
    "rfm": "SELECT customer_unique_id, recency, frequency, round(monetary, 2) AS monetary FROM rfm_t",
    "frequency_split": " UNION ALL ".join(
        f"SELECT 'freq{t}' AS grupo, count(*) FILTER (WHERE frequency {t}) AS clientes, round(count(*) FILTER (WHERE frequency {t}) * 100e0 / count(*), 6) AS pct FROM rfm_t"
        for t in ("=1", ">=2", ">=3")
    ),
    "cluster_stats": """SELECT cluster, round(avg(recency), 6) AS recency, round(avg(frequency), 6) AS frequency, round(avg(monetary), 4) AS monetary,
      count(*) AS n FROM rec2 GROUP BY cluster""",
    "segment_summary": """SELECT * FROM (SELECT segmento, count(*) AS clientes, round(avg(recency), 6) AS recency_med, round(avg(frequency), 6) AS freq_media,
      round(avg(monetary), 4) AS monetary_med, round(count(*) * 100e0 / sum(count(*)) OVER (), 6) AS pct,
      (SELECT count(*) FROM segmented WHERE segmento IS NULL) AS sin_segmento FROM segmented GROUP BY segmento) WHERE segmento IS NOT NULL""",
    "city_stats": "SELECT customer_city, customer_state, ordenes, round(ingresos_totales, 2) AS ingresos_totales, clientes_unicos FROM cities",
    "city_geo": "SELECT customer_city, customer_state, round(ingresos, 2) AS ingresos, ordenes, round(lat, 9) AS lat, round(lng, 9) AS lng FROM city_geo_t",
    "zip_centroid": "SELECT zip, round(lat, 9) AS lat, round(lng, 9) AS lng FROM zips",
    "weighted_centroid": """SELECT round(lat_opt, 9) AS lat_opt, round(lng_opt, 9) AS lng_opt, round(lat_simple, 9) AS lat_simple,
      round(lng_simple, 9) AS lng_simple, n_orders, round(ingresos, 2) AS ingresos FROM center""",
    "coverage_stats": """SELECT count(*) AS n_orders, round(avg(km), 6) AS km_mean, round(quantile_cont(km, 0.5), 6) AS km_median,
      round(quantile_cont(km, 0.8), 6) AS km_p80 FROM city_km""",
    "centroid_shift": """SELECT round(sqrt(power((lat_simple - lat_opt) * 111, 2)
      + power((lng_simple - lng_opt) * 111 * cos(radians(lat_opt)), 2)), 6) AS shift_km FROM center""",
    "match_coverage": """SELECT count(*) AS n_orders, count(lat) AS n_matched,
      count(*) FILTER (WHERE lat BETWEEN -34 AND 5 AND lng BETWEEN -74 AND -34) AS n_valid
      FROM order_rows LEFT JOIN zips ON customer_zip_code_prefix = zip""",
    "price_stats": """SELECT categoria, round(avg_price, 4) AS precio_promedio, min_price AS minimo, max_price AS maximo, units AS unidades_vendidas
      FROM category_sales""",
    "ticket_gap": """SELECT categoria, round(avg_price, 4) AS avg_price, rank() OVER (ORDER BY units DESC) AS rank_units,
      rank() OVER (ORDER BY revenue DESC) AS rank_revenue,
      rank() OVER (ORDER BY units DESC) - rank() OVER (ORDER BY revenue DESC) AS rank_gain FROM category_sales""",
    "ngram_counts": "SELECT n, term, freq, doc_freq FROM ngrams_t",
    "vocab_limit": "SELECT n, term, freq, doc_freq FROM ngrams_t QUALIFY row_number() OVER (PARTITION BY n ORDER BY freq DESC, term) <= 5000",
    "corpus_term_weights": """SELECT term, freq, round(freq / CAST(max(freq) OVER () AS DOUBLE), 6) AS weight
      FROM (SELECT * FROM ngrams_t WHERE n = 1 ORDER BY freq DESC, term LIMIT 150)""",
    "popularity": """SELECT 'global' AS scope, 'all' AS part, product, CAST(units AS BIGINT) AS units,
        row_number() OVER (ORDER BY units DESC, revenue DESC, product) AS rank FROM popular QUALIFY rank <= 10
      UNION ALL SELECT 'categoria', categoria, product, CAST(units AS BIGINT),
        row_number() OVER (PARTITION BY categoria ORDER BY units DESC, revenue DESC, product) AS rank
        FROM popular JOIN categories ON product = product_id QUALIFY rank <= 10
      UNION ALL SELECT 'segmento', segmento, product, CAST(units AS BIGINT),
        row_number() OVER (PARTITION BY segmento ORDER BY units DESC, revenue DESC, product) AS rank FROM popular_seg QUALIFY rank <= 10""",
    "feedback_metrics": _metrics(7 * 86400),
    # --- rankings
    "top_k_volume": """SELECT categoria AS categoria_producto_final, units AS volumen_total FROM category_sales ORDER BY units DESC, categoria LIMIT 5""",
    "top_k_revenue": """SELECT categoria AS categoria_producto_final, round(revenue, 2) AS ingreso_total FROM category_sales
      ORDER BY revenue DESC, categoria LIMIT 5""",
    "top_cities": """(SELECT 'ingresos_totales' AS criterio, customer_city, customer_state, ordenes, round(ingresos_totales, 2) AS ingresos_totales
        FROM cities ORDER BY cities.ingresos_totales DESC, customer_city, customer_state LIMIT 10)
      UNION ALL (SELECT 'ordenes', customer_city, customer_state, ordenes, round(ingresos_totales, 2)
        FROM cities ORDER BY ordenes DESC, customer_city, customer_state LIMIT 10)""",
    "best_city": "SELECT customer_city, customer_state, ordenes, round(ingresos_totales, 2) AS ingresos_totales, clientes_unicos FROM best",
    "top_k_per_pain": "SELECT pain, posicion, categoria, total_resenas, resenas_negativas_pain, round(tasa, 6) AS tasa FROM pain_top",
    "pain_multi_top": "SELECT categoria, count(*) AS n_pains FROM pain_top GROUP BY categoria HAVING count(*) >= 2",
    "top_ngrams": """SELECT n, term, freq, doc_freq, row_number() OVER (PARTITION BY n ORDER BY freq DESC, term) AS posicion
      FROM ngrams_t QUALIFY posicion <= 20""",
    "arg_extreme": """SELECT arg_min(cluster, (r, cluster)) AS cluster_min, arg_max(cluster, (r, -cluster)) AS cluster_max
      FROM (SELECT cluster, avg(recency) AS r FROM rec3 GROUP BY cluster)""",
    "argmax_k": "SELECT * FROM (SELECT * FROM sil2 UNION ALL SELECT * FROM sil3) ORDER BY silhouette DESC, k LIMIT 1",
    "segment_exemplar": """SELECT segmento, customer_unique_id, recency, frequency, round(monetary, 2) AS monetary FROM segmented WHERE segmento IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY segmento ORDER BY segmented.monetary DESC, customer_unique_id DESC) = 1""",
    "sample_fixed": "SELECT order_id, order_status FROM orders_p ORDER BY md5(concat(order_id, ':42')), order_id LIMIT 3000",
    "candidate_pool": """SELECT segmento, row_number() OVER (PARTITION BY segmento ORDER BY score DESC, product) AS rank, product, score
      FROM pool_rated QUALIFY rank <= 100""",
    # --- set operations and reshaping
    "union_segments": "SELECT customer_unique_id, recency, frequency, round(monetary, 2) AS monetary, segmento FROM segmented",
    "union_results": "SELECT review_id, pain_point_category, CASE WHEN review_id % 2 = 1 THEN 2 END AS run FROM classified",
    "zip_points": "SELECT round(lat, 9) AS lat, round(lng, 9) AS lng, round(ingresos, 2) AS weight FROM city_rows",
    "heat_grid": """SELECT CAST(floor(lat / 0.05e0) AS BIGINT) AS cell_lat, CAST(floor(lng / 0.05e0) AS BIGINT) AS cell_lng,
      round(sum(ingresos), 2) AS ingresos, count(*) AS ordenes FROM geo_rows GROUP BY 1, 2""",
    "catalog_doc": """SELECT '1.0' AS version, count(*) OVER () AS total_productos, row_number() OVER (ORDER BY id) - 1 AS pos, id, precio_promedio_real,
      unidades_vendidas, array_to_string(tags, '|') AS tags FROM products_t""",
    # --- machine learning
    "robust_scale": "SELECT customer_unique_id, round(recency_s, 6) AS recency_s, round(monetary_s, 6) AS monetary_s FROM scaled_all",
    "kmeans_fit": """SELECT cluster, count(*) AS n, round(avg(recency_s), 6) AS recency_s, round(avg(monetary_s), 6) AS monetary_s
      FROM recfit_labels WHERE k = 3 GROUP BY cluster""",
    "k_search": "SELECT k, round(silhouette, 6) AS silhouette FROM recfit_scores",
    "segment_customers": """SELECT customer_unique_id, recency, frequency, round(monetary, 2) AS monetary, segmento FROM recfit_chosen LEFT JOIN recfit_names USING (cluster)
      UNION ALL SELECT customer_unique_id, recency, frequency, round(monetary, 2), segmento FROM unifit_chosen LEFT JOIN unifit_names USING (cluster)""",
    "kmeans_assign": "SELECT customer_unique_id, cluster, round(dist2, 6) AS dist2 FROM rec3",
    "kmeans_step": """SELECT cluster, count(*) AS n, round(avg(recency_s), 6) AS recency_s, round(avg(monetary_s), 6) AS monetary_s FROM rec3 GROUP BY cluster""",
    "inertia": "SELECT round(sum(dist2), 4) AS inertia, count(*) AS n FROM rec3",
    "silhouette": "SELECT * FROM sil2 UNION ALL SELECT * FROM sil3",
    "segment_refresh": "SELECT customer_unique_id, cluster FROM rec2 WHERE recency <= 730",
    "item_cooccurrence": "SELECT product_a, product_b, n_customers FROM pairs",
    "item_cf_similarity": "SELECT product_a, product_b, round(similarity, 6) AS similarity FROM similar_t",
    "item_cf_rank": "SELECT customer, product, score, rank FROM cf_ranked",
    "content_similarity": "SELECT product, neighbour, round(price_gap, 4) AS price_gap, rank FROM content",
    "recommend_route": "SELECT customer, n_products, route FROM routes",
    "recommend_all": """SELECT customer, product, score, rank, 'item_cf' AS route FROM cf_ranked JOIN routes USING (customer) WHERE route = 'item_cf'
      UNION ALL SELECT customer, product, score, row_number() OVER (PARTITION BY customer ORDER BY score DESC, product) AS rank, 'content'
        FROM (SELECT customer, c.p_partkey AS product, round_even(max(1 / (1 + abs(b.p_retailprice - c.p_retailprice))
                + len(list_intersect(list_distinct([b.p_type, CAST(b.p_size AS VARCHAR)]), [c.p_type, CAST(c.p_size AS VARCHAR)])) / 2e0), 6) AS score
              FROM bought JOIN routes USING (customer) JOIN buyer_segments USING (customer) JOIN part b ON b.p_partkey = bought.product
              JOIN pool_top ON pool_top.segmento = buyer_segments.segmento JOIN part c ON c.p_partkey = pool_top.product AND c.p_brand = b.p_brand
              WHERE route = 'content' GROUP BY 1, 2) ANTI JOIN bought USING (customer, product) QUALIFY rank <= 10
      UNION ALL SELECT customer, product, CAST(units AS DOUBLE), rank, 'popular' FROM routes, (SELECT *,
        row_number() OVER (ORDER BY units DESC, revenue DESC, product) AS rank FROM popular QUALIFY rank <= 10) WHERE route = 'popular'""",
    "implicit_weights": "SELECT customer_id, product_id, score, n_events FROM scores",
    "publish_pools": """SELECT segmento, row_number() OVER (PARTITION BY segmento ORDER BY score DESC, product) AS rank, product, score
      FROM pool_plain QUALIFY rank <= 100""",
    # --- user functions
    "classify_complaints": "SELECT review_id, order_id, review_score, pain_point_category FROM classified",
    "classify_plugged": f"""SELECT review_id, list_extract([{_list(TAXONOMY)}], CAST(length(p) % {len(TAXONOMY)} AS INTEGER) + 1) AS pain_point_category
      FROM (SELECT review_id, concat({_q(_PROMPT_HEAD)}, regexp_replace(review_comment_message, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), {_q(_PROMPT_TAIL)}) AS p FROM corpus)""",
    "apply_clean": "SELECT p_partkey, " + ", ".join(f"array_to_string({_tokens(c)}, ' ') AS {c}_limpio" for c in ("p_name", "p_brand", "p_type")) + " FROM part",
    "agg_lambda": """SELECT customer_unique_id, CAST(floor(date_diff('microsecond', max(order_purchase_timestamp), any_value(ref)) / 86400000000) AS BIGINT) AS recency,
      CAST(floor(date_diff('microsecond', min(order_purchase_timestamp), max(order_purchase_timestamp)) / 86400000000) AS BIGINT) AS span_days,
      round(max(ingresos) - min(ingresos), 2) AS ticket_range
      FROM order_rows, (SELECT max(order_purchase_timestamp) + INTERVAL 1 DAY AS ref FROM delivered) GROUP BY customer_unique_id""",
    # --- streaming, equal to the batch over the same events
    "stream_event_counts": f"""SELECT strftime(w, '{_COLS}') AS window_start, customer_id, event_type, count(*) AS n
      FROM (SELECT date_trunc('day', ts) AS w, * FROM events_p) GROUP BY ALL""",
    "stream_implicit_scores": "SELECT customer_id, product_id, score, n_events FROM scores",
    "stream_sessions": f"""SELECT customer_id, strftime(first_ts, '{_COLS}') AS session_start, n_events,
      round(date_diff('microsecond', first_ts, last_ts) / 1000000e0, 6) AS dwell_seconds FROM visits""",
    "stream_dedup": "SELECT event_id, customer_id, event_type, product_id FROM events_p",
    "stream_feedback": f"SELECT served_id, action FROM ({_feedback(86400)})",
    "stream_feedback_metrics": _metrics(86400),
    "stream_classify": "SELECT review_id, order_id, review_score, pain_point_category FROM classified",
}
def _named(sql: str) -> list[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))
    return [name for name in VIEWS if name in words]


def statement(body: str) -> str:
    """``body`` with the views it needs in front."""
    needed: set[str] = set()
    todo = _named(body)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += _named(VIEWS[name])
    if not needed:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed) + "\n" + body


ORACLES: dict[str, str] = {key: statement(body) for key, body in BODIES.items()}
