"""Input tables derived from the test data.

The test data holds no listings, so every query first derives its input with plain integer and
string SQL over the whole given tables. The text is the same for Spark and for DuckDB; moduli
smaller than the tables make numbers, sites and profiles collide.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.schemas import FINDING_DDL
from leadweave.sources.scans import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

#: Tables that are only looked up.
SMALL = ("region", "nation")
#: Views whose rows are parsed or matched at length.
COSTLY = ("html_pages", "urls")

VIEWS = {
    "businesses": """
        SELECT c_custkey AS id,
          'place_id:ChI' || lpad(CAST(c_custkey AS STRING), 12, '0') AS place_id,
          'https://www.google.com/maps/place/n' || CAST(c_custkey AS STRING) AS google_maps_url,
          c_name AS business_name, c_mktsegment AS category, translate(n_name, '0123456789_', 'abcdefghij-') AS city,
          'Calle ' || CAST(c_custkey AS STRING) || ', 2820000 ' || translate(n_name, '0123456789_', 'abcdefghij-') || ', Chile' AS address,
          CASE WHEN c_custkey % 11 = 0 THEN NULL
               WHEN c_custkey % 5 = 0 THEN '+5622' || CAST(2000000 + (c_custkey * 13) % 1201 AS STRING)
               ELSE '+569' || CAST(30000000 + (c_custkey * 7) % 1201 AS STRING) END AS phone_e164,
          CASE WHEN c_custkey % 9 = 0 THEN NULL
               WHEN c_custkey % 9 = 1 THEN 'https://linktr.ee/Neg' || CAST((c_custkey * 3) % 701 AS STRING)
               WHEN c_custkey % 9 = 2 THEN 'https://www.instagram.com/Neg' || CAST((c_custkey * 3) % 503 AS STRING) || '/'
               ELSE 'https://www.n' || CAST((c_custkey * 11) % 997 AS STRING) || '.cl/inicio?utm_source=maps' END AS website,
          CASE WHEN c_custkey % 9 = 0 THEN 'SIN_WEB' WHEN c_custkey % 7 < 4 THEN 'OK' WHEN c_custkey % 7 = 4 THEN 'CAIDO'
               WHEN c_custkey % 7 = 5 THEN 'SOLO_REDES' ELSE NULL END AS website_status,
          CASE WHEN c_custkey % 4 = 0 THEN 'VERIFICADO' WHEN c_custkey % 4 = 1 THEN 'NO CONFIRMADO'
               WHEN c_custkey % 4 = 2 THEN 'NO ENCONTRADO' ELSE 'VERIFICADO' END AS whatsapp_status,
          CASE WHEN c_custkey % 4 = 0 THEN 'https://wa.me/569' || CAST(30000000 + (c_custkey * 5) % 1303 AS STRING)
               WHEN c_custkey % 4 = 3 THEN 'https://wa.me/message/M' || CAST(c_custkey AS STRING) ELSE NULL END AS whatsapp_url,
          CASE WHEN c_custkey % 4 IN (0, 3) THEN CASE WHEN c_custkey % 3 = 0 THEN 'ALTA' ELSE 'MEDIA' END ELSE NULL END AS whatsapp_confidence,
          CASE WHEN c_custkey % 10 = 0 THEN 'EXISTE' WHEN c_custkey % 10 = 1 THEN 'NO_EXISTE' ELSE NULL END AS whatsapp_check,
          c_custkey % 15 = 0 AS whatsapp_broken_button,
          CASE WHEN c_custkey % 17 = 0 THEN 'El WhatsApp no existe' ELSE NULL END AS discard_reason,
          CASE WHEN c_custkey % 19 = 0 THEN 'Tiene la misma web' ELSE NULL END AS duplicate_reason,
          CASE WHEN c_custkey % 6 = 0 THEN 'https://www.instagram.com/Perfil' || CAST(c_custkey % 503 AS STRING) || '/' ELSE NULL END AS instagram,
          CASE WHEN c_custkey % 8 = 0 THEN 'https://m.facebook.com/Pagina' || CAST(c_custkey % 601 AS STRING) ELSE NULL END AS facebook,
          CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(30 + c_custkey % 21 AS DOUBLE) / 10 END AS rating,
          CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE (c_custkey * 17) % 240 END AS review_count,
          CASE WHEN c_custkey % 14 = 0 THEN 'https://linktr.ee/Neg' || CAST(c_custkey % 701 AS STRING) ELSE NULL END AS website_maps,
          CASE WHEN c_custkey % 7 = 4 THEN 'web: La web responde con error 404' ELSE NULL END AS status_note
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "searches": """
        SELECT o_orderkey AS id, o_orderpriority AS query, o_orderdate AS created_at,
          CASE o_orderstatus WHEN 'F' THEN 'TERMINADA' WHEN 'O' THEN 'EN_CURSO' ELSE 'DETENIDA' END AS status
        FROM {orders}""",
    "search_results": """
        SELECT l_orderkey AS search_id, (l_partkey * 31 + l_suppkey) % (SELECT count(*) FROM {customer}) AS business_id,
          min(l_linenumber) AS position
        FROM {lineitem} GROUP BY 1, 2""",
    "contacted": """
        SELECT min(s_suppkey) AS id, min(s_name) AS name, phone_e164,
          CASE WHEN min(s_suppkey) % 3 = 0 THEN 'contactado' WHEN min(s_suppkey) % 3 = 1 THEN 'demo enviada' ELSE NULL END AS status,
          CASE WHEN min(s_suppkey) % 2 = 0 THEN 'lunes 30 de agosto' ELSE NULL END AS contacted_on
        FROM (SELECT s_suppkey, s_name, '+569' || CAST(30000000 + (s_suppkey * 37) % 1201 AS STRING) AS phone_e164 FROM {supplier}) AS s
        GROUP BY phone_e164""",
    "analyses": """
        SELECT event_id AS id, (event_id * 7) % (SELECT count(*) FROM {customer}) AS business_id, ts AS analyzed_at,
          CASE WHEN event_type = 'error' THEN 'La web no abrió' ELSE NULL END AS error,
          CASE WHEN event_type = 'purchase' THEN NULL ELSE CAST(floor(value) AS BIGINT) % 100 END AS website_score,
          CASE WHEN event_type = 'purchase' THEN NULL WHEN CAST(floor(value) AS BIGINT) % 100 < 40 THEN 'ALTA'
               WHEN CAST(floor(value) AS BIGINT) % 100 < 70 THEN 'MEDIA' ELSE 'BAJA' END AS opportunity_level,
          event_id % 4 AS n_findings, CASE WHEN event_id % 4 > 0 AND event_id % 3 = 0 THEN 1 ELSE 0 END AS n_serious,
          CAST(floor(value * 20) AS BIGINT) AS load_ms,
          CASE WHEN event_id % 5 = 0 THEN event_id % 101 ELSE NULL END AS psi,
          event_id % 9 AS n_errors
        FROM {events}""",
    "urls": """
        SELECT o_orderkey AS url_id,
          CASE k
            WHEN 3 THEN 'HTTPS://WWW.Neg' || CAST(page_id AS STRING) || '.CL/Servicios?utm_source=g&id=' || CAST(page_id % 7 AS STRING) || '#precios'
            WHEN 4 THEN 'https://wa.me/5691' || CAST(1000000 + page_id AS STRING)
            WHEN 5 THEN 'https://api.whatsapp.com/send?phone=52155' || CAST(10000000 + page_id AS STRING) || '&text=hola'
            WHEN 6 THEN 'https://www.instagram.com/Neg' || CAST(page_id AS STRING) || '/'
            WHEN 7 THEN 'https://www.facebook.com/sharer/sharer.php?u=https://n' || CAST(page_id AS STRING) || '.cl'
            WHEN 8 THEN 'https://linktr.ee/Neg' || CAST(page_id AS STRING)
            WHEN 9 THEN 'https://www.google.com/maps/place/N' || CAST(page_id AS STRING) || '/@-34.17,-70.74,17z/data=!1s0xAB' || CAST(page_id AS STRING) || ':0x1C?entry=ttu'
            WHEN 10 THEN 'https://maps.google.com/?cid=' || CAST(100000 + page_id AS STRING) || '&hl=es'
            WHEN 11 THEN 'mailto:hola@n' || CAST(page_id AS STRING) || '.cl'
            WHEN 12 THEN 'neg' || CAST(page_id AS STRING) || '.cl'
            WHEN 13 THEN 'https://sites.google.com/view/neg-' || CAST(page_id AS STRING) || '/inicio'
            WHEN 14 THEN 'https://m.facebook.com/profile.php?id=' || CAST(5000 + page_id AS STRING) || '&x=1'
            WHEN 15 THEN 'https://wa.me/message/AB' || CAST(page_id AS STRING)
            WHEN 16 THEN 'http://usuario' || CAST(page_id % 50 AS STRING) || '.wixsite.com:80/Sitio' || CAST(page_id AS STRING) || '/contacto'
            WHEN 17 THEN 'https://www.youtube.com/channel/UC' || CAST(page_id AS STRING) || '/videos'
            WHEN 18 THEN 'https://www.n' || CAST(page_id AS STRING) || '.cl:8080/a/b?z=1&a=2'
            WHEN 0 THEN '/url?q=https%3A%2F%2Fn' || CAST(page_id AS STRING) || '.cl%2F%3Fa%3D1&sa=U'
            WHEN 1 THEN 'https://www.google.cl/url?sa=t&url=https://www.instagram.com/Neg' || CAST(page_id AS STRING)
            WHEN 2 THEN '/url?q=https://www.google.com/url?q%3Dhttps://n' || CAST(page_id AS STRING) || '.cl/'
            ELSE '' END AS url, k AS form
        FROM (SELECT o_orderkey, o_orderkey % 20 AS k, o_orderkey AS page_id FROM {orders}) AS o
        UNION ALL
        SELECT page_id + 10000000000 AS url_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN '/url?q=' || url || '&sa=U&ved=2'
            ELSE 'https://www.google.cl/url?sa=t&url=' || url END AS url, 20 + page_id % 3 AS form
        FROM {pages}""",
    "phones": """
        SELECT c_custkey AS id,
          CASE c_custkey % 12
            WHEN 0 THEN '+56 9 ' || CAST(3000 + c_custkey % 5000 AS STRING) || ' ' || CAST(1000 + c_custkey % 9000 AS STRING)
            WHEN 1 THEN '9 ' || CAST(3000 + c_custkey % 5000 AS STRING) || ' ' || CAST(1000 + c_custkey % 9000 AS STRING)
            WHEN 2 THEN '(72) ' || CAST(200 + c_custkey % 700 AS STRING) || ' ' || CAST(1000 + c_custkey % 9000 AS STRING)
            WHEN 3 THEN '56' || CAST(930000000 + c_custkey AS STRING)
            WHEN 4 THEN '+52 1 55 ' || CAST(1000 + c_custkey % 9000 AS STRING) || ' ' || CAST(1000 + c_custkey % 8999 AS STRING)
            WHEN 5 THEN '+54 9 11 ' || CAST(2000 + c_custkey % 7000 AS STRING) || '-' || CAST(1000 + c_custkey % 9000 AS STRING)
            WHEN 6 THEN '+1 (305) 555-' || CAST(1000 + c_custkey % 9000 AS STRING)
            WHEN 7 THEN '+34 6' || CAST(10000000 + c_custkey AS STRING)
            WHEN 8 THEN '123'
            WHEN 9 THEN 'llamar ya'
            WHEN 10 THEN NULL
            ELSE '+34 91' || CAST(1000000 + c_custkey % 8000000 AS STRING) END AS raw
        FROM {customer}""",
    "candidates": """
        SELECT (o_custkey * 2) % (SELECT count(*) FROM {customer}) AS site_id, o_orderkey AS arrival,
          CASE WHEN o_orderkey % 97 = 0 THEN 'manual' WHEN o_orderpriority LIKE '1%' THEN 'maps' WHEN o_orderpriority LIKE '5%' THEN 'linktree'
               WHEN o_orderpriority LIKE '4%' THEN 'otra' ELSE 'web' END AS source,
          CASE o_orderkey % 4 WHEN 0 THEN 'flotante' WHEN 1 THEN 'header' WHEN 2 THEN 'cuerpo' ELSE 'footer' END AS placement,
          CASE WHEN o_orderkey % 6 = 0 THEN NULL
               WHEN o_custkey % 2 = 0 THEN '569' || CAST(30000000 + (o_custkey * 14) % 1201 AS STRING)
               ELSE '569' || CAST(40000000 + (o_custkey * 3 + o_orderkey % 2) % 1201 AS STRING) END AS number,
          o_orderkey % 7 = 0 AS broken
        FROM {orders}""",
    "actions": """
        SELECT event_id, user_id AS business_id, ts,
          CASE event_type WHEN 'purchase' THEN 'confirm' WHEN 'error' THEN 'discard' WHEN 'signup' THEN 'restore' ELSE 'view' END AS action
        FROM {events}""",
    "attempts": """
        SELECT user_id AS site_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt,
          CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 503 WHEN 'signup' THEN 404 WHEN 'purchase' THEN 429 ELSE NULL END AS status,
          CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'dns' WHEN event_id % 3 = 1 THEN 'timeout' ELSE 'connect' END ELSE NULL END AS error_kind,
          CASE WHEN event_type = 'error' THEN 'fallo' ELSE NULL END AS error
        FROM {events}""",
    "html_pages": """
        SELECT page_id, url, replace(html, '<head>', '<head><meta name="Description" content="Desc ' || CAST(page_id AS STRING)
            || '"><link rel="shortcut icon" href="/fav' || CAST(page_id % 5 AS STRING) || '.png"><link rel="canonical" href="/c' || CAST(page_id AS STRING)
            || '?utm_source=x#y"><meta property="og:title" content="OG ' || CAST(page_id AS STRING) || '">'
            || CASE WHEN page_id % 6 = 0 THEN '<link rel="stylesheet" href="/wp-content/themes/astra/style.css">' ELSE '' END)
          || '<h2>Servicios</h2><h2>Zona ' || CAST(page_id AS STRING) || '</h2><p>'
          || CASE WHEN page_id % 2 = 0 THEN 'Despacho a la comuna de ' ELSE 'Visitamos ' END || translate(n_name, '0123456789_', 'abcdefghij-') || '</p>'
          || CASE WHEN page_id % 7 = 0 THEN '<div class="joinchat" data-settings=''{"telephone":"569' || CAST(50000000 + page_id AS STRING) || '"}''></div>' ELSE '' END
          || '<footer class="site-footer"><a href="https://wa.me/569' || CAST(30000000 + page_id * 7 AS STRING)
          || '?text=Hola">WA</a><a href="tel:+569' || CAST(40000000 + page_id AS STRING) || '">Llamar</a>'
          || '<a href="mailto:Ventas' || CAST(page_id AS STRING) || '@neg.cl?subject=x">correo</a>'
          || '<a href="https://www.instagram.com/Neg' || CAST(page_id AS STRING) || '/">IG</a>'
          || '<a href="https://www.google.com/maps/place/N' || CAST(page_id AS STRING) || '">Mapa</a>'
          || CASE WHEN page_id % 11 = 0 THEN '<a href="https://chat.whatsapp.com/G' || CAST(page_id AS STRING) || '">Grupo</a>' ELSE '' END
          || CASE WHEN page_id % 13 = 0 THEN '<a href="https://wa.me/123">Mal</a>' ELSE '' END
          || CASE WHEN page_id % 17 = 0 THEN '<a href="https://wa.link/c' || CAST(page_id AS STRING) || '">Corto</a>' ELSE '' END
          || '<img src="/logo' || CAST(page_id % 9 AS STRING) || '.png"><img src="/foto.png" alt="Foto"><img src="data:image/png;base64,x" alt=" ">'
          || CASE WHEN page_id % 3 = 0 THEN '<form action="/c"></form>' ELSE '' END
          || CASE WHEN page_id % 4 = 0 THEN '<iframe src="https://www.google.com/maps/embed?pb=1"></iframe>' ELSE '' END
          || '<p>© ' || CAST(2015 + page_id % 10 AS STRING) || ' Negocio. Garantía total.</p>'
          || CASE WHEN page_id % 5 = 0 THEN '<script type="application/ld+json">{"@graph":[{"@type":"Plumber","name":"N' || CAST(page_id AS STRING) || '"},[[[{"@type":["Thing","Offer"]}]]],{"@graph":{"@graph":[{"@graph":[{"@type":"Deep' || CAST(page_id AS STRING) || '"}]}]}}]}</script>' ELSE '' END
          || '</footer>' AS html, page_id % 50 AS site_id
        FROM {pages} JOIN {nation} ON n_nationkey = page_id % 25""",
    "contact_lines": """
        SELECT s_suppkey AS line_no,
          CASE s_suppkey % 6
            WHEN 0 THEN 'taller ' || CAST(s_suppkey AS STRING) || '\t+56 9 3' || CAST(1000000 + s_suppkey % 400 AS STRING) || '\tContactado\t1:39 pm\tlunes 30'
            WHEN 1 THEN 'estudio ' || CAST(s_suppkey AS STRING) || '\t+56 9 3' || CAST(1000000 + s_suppkey % 400 AS STRING) || '\t7:00 pm\tmartes 2\tchecked'
            WHEN 2 THEN 'sin columnas ' || CAST(s_suppkey AS STRING) || ' +56 9 3' || CAST(1000000 + s_suppkey % 400 AS STRING) || ' contactado'
            WHEN 3 THEN 'nombre\ttelefono\testado\thora'
            WHEN 4 THEN '   '
            ELSE '\t+56 9 3' || CAST(1000000 + s_suppkey % 400 AS STRING) END AS line
        FROM {supplier}""",
    "listings": """
        SELECT id AS listing_id, CAST(floor(id / 40) AS BIGINT) AS run_id, id % 40 + 1 AS position, id AS rank, 12 AS target,
          id % 37 = 0 AS known_stored,
          id % 4 = 0 OR (website IS NOT NULL AND website NOT LIKE '%instagram%') AS card_has_site, id % 31 <> 0 AS readable,
          coalesce(website_status = 'OK', false) AS site_open,
          duplicate_reason IS NULL AND discard_reason IS NULL AND (whatsapp_status = 'VERIFICADO' OR coalesce(phone_e164 LIKE '+569%', false)) AS is_lead,
          'place:' || CAST((id * 3) % 1201 AS STRING) AS place
        FROM {businesses}""",
}


def _names(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{([a-z]\w*)\}", sql)))


def duck(sql: str) -> str:
    """DuckDB form of a query text: ``{view}`` becomes a CTE of the derived input, ``{table}`` the table."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for inner in _names(VIEWS[name]):
                visit(inner)
            ordered.append(name)

    for name in _names(sql):
        visit(name)

    def fill(text: str) -> str:
        return re.sub(r"\{([a-z]\w*)\}", lambda m: f"v_{m[1]}" if m[1] in VIEWS else m[1], text)

    head = ",\n".join(f"v_{name} AS ({fill(VIEWS[name])})" for name in ordered)
    body = fill(sql).strip()
    if not head:
        return body
    match = re.match(r"(?is)^with\s+(recursive\s+)?", body)
    if match:
        return f"WITH {match[1] or ''}{head},\n{body[match.end():]}"
    return f"WITH {head}\n{body}"


class Inputs:
    """The given tables and derived inputs of one data folder."""

    def __init__(self, spark: SparkSession, folder: str, dealt: bool = False) -> None:
        self.spark = spark
        self.folder = folder
        self._dealt = dealt

    @property
    def dealt(self) -> Inputs:
        """The same tables for jobs that work long on each row: a scan of few splits uses all task slots."""
        return Inputs(self.spark, self.folder, dealt=True)

    def table(self, name: str) -> DataFrame:
        scan = self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}.parquet")
        return spread(scan) if self._dealt and name not in SMALL else scan

    def __getattr__(self, name: str) -> DataFrame:
        if name in COSTLY and not self._dealt:
            return getattr(self.dealt, name)
        if name in VIEWS:
            # Braces that are no placeholders (JSON inside text) are doubled for Spark's formatter.
            sql = re.sub(r"\{\{([a-z]\w*)\}\}", r"{\1}", VIEWS[name].replace("{", "{{").replace("}", "}}"))
            return self.spark.sql(sql, **{n: (getattr(self, n) if n in VIEWS else self.table(n)) for n in _names(VIEWS[name])})
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    # Typed tables on top of the flat views: maps and arrays have no common SQL spelling.
    def businesses_full(self) -> DataFrame:
        entries = F.array_compact(F.array(*[
            F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("key"), F.col(c).alias("value")))
            for k, c in (("website_maps", "website_maps"), ("website_status", "status_note"))
        ]))
        return self.businesses.withColumns({
            "field_sources": F.map_from_entries(entries),
            "discarded_at": F.when(F.col("discard_reason").isNotNull(), F.to_timestamp(F.lit("2024-01-05 00:00:00"))),
            "phone_raw": F.regexp_replace("phone_e164", r"^\+", ""),
            "review_count": F.col("review_count").cast("int"),
        }).drop("website_maps", "status_note")

    def searches_full(self) -> DataFrame:
        return self.searches.withColumn("created_at", F.col("created_at").cast("timestamp"))

    def analyses_full(self) -> DataFrame:
        n = F.col("n_findings")
        findings = F.transform(
            F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda i: i <= n),
            lambda i: F.struct(
                F.lit("x").alias("code"), F.concat(F.lit("Hallazgo "), i.cast("string")).alias("title"), F.lit(None).cast("string").alias("detail"),
                F.array().cast("array<string>").alias("evidence"),
                F.when((i == 1) & (F.col("n_serious") == 1), "alta").otherwise("media").alias("severity"),
                F.lit(None).cast("int").alias("param"), F.lit(None).cast("string").alias("capture"),
            ),
        ).cast(f"array<{FINDING_DDL}>")
        texts = F.array().cast("array<string>")
        return self.analyses.withColumns({
            "findings": findings, "analyzed_at": F.col("analyzed_at").cast("timestamp"), "website_score": F.col("website_score").cast("int"),
            "screenshots": F.create_map().cast("map<string,string>"), "main_problems": texts, "opportunities": texts, "strengths": texts,
            "model_name": F.lit(None).cast("string"),
        })
