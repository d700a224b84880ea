"""DuckDB SQL with the rows of the queries of the catalog."""

from __future__ import annotations

from ..functions.blocks import LUMINANCE, ZIGZAG
from ..functions.script import normalize_sql
from ..operators.policy import ERRORS
from ..sources.lexicon import NEUTRAL
from ..sources.tables import IMAGE_SHIFT, PCM_RATE
from ..sources.vocabulary import NEUTRAL as WORDS
from ..sources.vocabulary import NEUTRAL_THRESHOLD

_q = lambda s: "'" + s.replace("'", "''") + "'"
_LEX = "lex(category, ordinal, pattern) AS (VALUES " + ", ".join(f"({_q(c)}, {k}, {_q(p)})" for c, ps in NEUTRAL.items() for k, p in enumerate(ps)) + ")"
_VOCAB = "vocab(word, weight) AS (VALUES " + ", ".join(f"({_q(w)}, CAST({sum(v)} AS DOUBLE) / 127) " for w, v in WORDS.items()) + ")"
_N = f"n AS (SELECT doc_id, text, {normalize_sql('text')} AS n FROM documents)"
_FIRST = f"""{_LEX}, {_N}, hits AS (SELECT doc_id, pattern, instr(n, pattern) + length(pattern) AS stop FROM n JOIN lex ON contains(n, pattern)),
first AS (SELECT doc_id, arg_min(pattern, stop * 100000 - length(pattern)) AS matched_pattern FROM hits GROUP BY doc_id)"""
_TOKENS = "list_filter(string_split_regex({}, '[ \\t\\n\\x0B\\f\\r!-/:-@\\[-`{{-~]+'), lambda t: t <> '')"
_SCORE = f"""{_VOCAB}, tok AS (SELECT doc_id, unnest({_TOKENS.format('n')}) AS word FROM n), cnt AS (SELECT doc_id, count(*) AS k FROM tok GROUP BY 1),
mean AS (SELECT doc_id, avg(weight) AS m FROM tok JOIN vocab USING (word) GROUP BY 1),
score AS (SELECT n.doc_id, coalesce(length(text), 0) > 0 AS is_valid, CASE WHEN k IS NULL THEN 0.0::DOUBLE WHEN m IS NULL THEN 0.001::DOUBLE ELSE 1 / (1 + exp(-m)) END AS score
FROM n LEFT JOIN cnt ON cnt.doc_id = n.doc_id LEFT JOIN mean ON mean.doc_id = n.doc_id)"""

_px = lambda shift, scale: f"CAST(greatest(0, least(255, floor({shift}.0::DOUBLE + {scale}.0::DOUBLE * CAST(v AS DOUBLE)))) AS INTEGER)"
_EMB = "emb AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding) AS v FROM embeddings WHERE len(embedding) = 64)"
_BLOCK = f"{_EMB}, blk AS (SELECT vec_id, label, CAST(k AS INTEGER) AS k, {_px(128, 256)} AS px FROM emb)"
_COS = "basis AS (SELECT u + 8 * v AS k, x + 8 * y AS j, 0.25::DOUBLE * (CASE WHEN u = 0 THEN sqrt(0.5::DOUBLE) ELSE 1 END) * (CASE WHEN v = 0 THEN sqrt(0.5::DOUBLE) ELSE 1 END) * cos((2 * x + 1) * u * pi() / 16) * cos((2 * y + 1) * v * pi() / 16) AS b FROM range(8) a(u), range(8) c(v), range(8) d(x), range(8) e(y))"
_DCT = f"{_BLOCK}, {_COS}, dct AS (SELECT vec_id, label, CAST(b.k AS INTEGER) AS k, round(sum((px - 128) * b), 6) AS c FROM blk JOIN basis b ON b.j = blk.k GROUP BY ALL)"
_QT = "qt AS (SELECT CAST(i - 1 AS INTEGER) AS k, t[i] AS q FROM (SELECT " + str(LUMINANCE) + " AS t), range(1, 65) r(i))"
_QUANT = f"{_DCT}, {_QT}, quant AS (SELECT vec_id, label, k, CAST(round(round(c / q, 9)) AS INTEGER) AS v FROM dct JOIN qt USING (k))"
_ZZ = f"{_QUANT}, zo AS (SELECT CAST(i - 1 AS INTEGER) AS p, t[i] AS k FROM (SELECT {ZIGZAG} AS t), range(1, 65) r(i)), zz AS (SELECT vec_id, label, p AS k, v AS q FROM quant JOIN zo USING (k))"
_INV = f"{_QUANT}, inv AS (SELECT vec_id, CAST(b.j AS INTEGER) AS k, round(sum(v * q * b), 6) AS v FROM quant JOIN qt USING (k) JOIN basis b ON b.k = quant.k GROUP BY ALL)"
_REC = f"{_INV}, rec AS (SELECT vec_id, k, CAST(least(255, greatest(0, round(v + 128))) AS INTEGER) AS px FROM inv)"

_CH = lambda c: f"max(CASE WHEN vec_id % 3 = {c} THEN {_px(IMAGE_SHIFT[c], 400)} END)"
_IMG = f"{_EMB}, img AS (SELECT vec_id // 3 AS image_id, k, {_CH(0)} AS r, {_CH(1)} AS g, {_CH(2)} AS b, count(*) AS c FROM emb GROUP BY 1, 2)"
_SKIN = f"""{_IMG}, skin AS (SELECT image_id, k, CAST(r > 95 AND g > 40 AND b > 20 AND greatest(r, g, b) - least(r, g, b) > 15 AND abs(r - g) > 15 AND r > g AND r > b
AND 128.0::DOUBLE - 0.168736::DOUBLE * r - 0.331264::DOUBLE * g + 0.5::DOUBLE * b BETWEEN 77 AND 127 AND 128.0::DOUBLE + 0.5::DOUBLE * r - 0.418688::DOUBLE * g - 0.081312::DOUBLE * b BETWEEN 133 AND 173 AS INTEGER) AS s FROM img WHERE c = 3)"""
_COMP = f"""{_SKIN}, on_ AS (SELECT image_id, k, k % 8 AS x, k // 8 AS y FROM skin WHERE s = 1),
reach AS (SELECT image_id, k, k AS root FROM on_ UNION SELECT b.image_id, b.k, r.root FROM reach r JOIN on_ a ON a.image_id = r.image_id AND a.k = r.k JOIN on_ b ON b.image_id = a.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
lab AS (SELECT image_id, k, min(root) AS root FROM reach GROUP BY 1, 2),
comp AS (SELECT image_id, CAST(min(k % 8) AS INTEGER) AS x, CAST(min(k // 8) AS INTEGER) AS y, CAST(max(k % 8) - min(k % 8) + 1 AS INTEGER) AS width, CAST(max(k // 8) - min(k // 8) + 1 AS INTEGER) AS height, count(*) AS pixel_count FROM lab GROUP BY image_id, root HAVING count(*) >= 4)"""

_CLIP = "clip AS (SELECT l_returnflag AS clip_id, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, l_shipdate) - 1 AS i, (l_quantity - 25.5::DOUBLE) / 25.5::DOUBLE AS v FROM lineitem)"
_ENV = f"{_CLIP}, fr AS (SELECT clip_id, i // 512 AS frame, sqrt(sum(v * v) / 512) AS e FROM clip GROUP BY 1, 2 HAVING count(*) = 512), env AS (SELECT clip_id, frame, greatest(0.0::DOUBLE, e - lag(e, 1, 0.0::DOUBLE) OVER (PARTITION BY clip_id ORDER BY frame)) AS flux FROM fr)"
_LAGS = f"CAST(floor({PCM_RATE} / 512.0 * 0.3) AS BIGINT), CAST(floor({PCM_RATE} / 512.0) AS BIGINT) + 1"
_AC = f"{_ENV}, lags AS (SELECT 0 AS lag UNION ALL SELECT unnest(range({_LAGS}))), ac AS (SELECT a.clip_id, CAST(lag AS INTEGER) AS lag, sum(a.flux * b.flux) AS value FROM env a CROSS JOIN lags JOIN env b ON b.clip_id = a.clip_id AND b.frame = a.frame + lag GROUP BY 1, 2)"
_BPM = f"""{_AC}, top AS (SELECT clip_id, max(value) FILTER (lag > 0) AS m, max(value) FILTER (lag = 0) AS z FROM ac GROUP BY 1),
best AS (SELECT top.clip_id, m, z, min(lag) AS lag FROM top JOIN ac ON ac.clip_id = top.clip_id AND ac.value = m AND lag > 0 GROUP BY ALL),
size AS (SELECT clip_id, count(*) AS n, sqrt(avg(v * v)) AS rms FROM clip GROUP BY 1),
ok AS (SELECT size.clip_id, rms, n >= {PCM_RATE} AND n // 512 >= 10 AND coalesce(m > 0 AND z > 0, false) AS good, lag, m, z FROM size LEFT JOIN best ON best.clip_id = size.clip_id),
bpm AS (SELECT clip_id, rms, CASE WHEN good THEN 60.0::DOUBLE * ({PCM_RATE} / 512.0::DOUBLE) / lag ELSE 0.0::DOUBLE END AS bpm, CASE WHEN good THEN least(1.0::DOUBLE, m / z) ELSE 0.0::DOUBLE END AS confidence FROM ok)"""

_PCM = "pcm AS (SELECT event_type AS clip_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, CAST(((CAST(floor(value * 997) AS BIGINT) % 65536 + 65536) % 65536) - 32768 AS INTEGER) AS s FROM events)"
_BYTES = f"""{_PCM}, hex AS (SELECT clip_id || ':' || (i // 256) AS clip_id, string_agg(printf('%02x', CAST(((s + 65536) % 65536) % 256 AS INTEGER)) || printf('%02x', CAST(((s + 65536) % 65536) // 256 AS INTEGER)), '' ORDER BY i) AS h FROM pcm GROUP BY 1)"""

_FRAMES = f"""{_BLOCK}, nb AS (SELECT vec_id, label AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings WHERE len(embedding) = 64),
fp AS (SELECT b.video_id, n // 4 AS f, (n % 4 // 2) * 8 + k // 8 AS y, (n % 2) * 8 + k % 8 AS x, px, count(*) OVER (PARTITION BY b.video_id, n // 4) AS c FROM nb b JOIN blk ON blk.vec_id = b.vec_id),
f AS (SELECT video_id, f AS frame_no, x, y, px FROM fp WHERE c = 256),
cand AS (SELECT * FROM range(2) a(cy), range(2) b(bx), range(-8, 9) c(dy), range(-8, 9) d(dx) WHERE cy * 8 + dy BETWEEN 0 AND 8 AND bx * 8 + dx BETWEEN 0 AND 8),
sad AS (SELECT n.video_id, n.frame_no, cy * 2 + bx AS block, dx, dy, sum(abs(n.px - o.px)) AS sad FROM cand JOIN f n ON n.x // 8 = bx AND n.y // 8 = cy JOIN f o ON o.video_id = n.video_id AND o.frame_no = n.frame_no - 1 AND o.x = n.x + dx AND o.y = n.y + dy GROUP BY ALL),
mv AS (SELECT video_id, frame_no, block, dx, dy, sad FROM sad QUALIFY row_number() OVER (PARTITION BY video_id, frame_no, block ORDER BY sad, dy, dx) = 1)"""

_REQ = """req AS (SELECT event_id, event_id % 10 AS k, event_type FROM events),
route AS (SELECT event_id AS request_id,
CASE k WHEN 0 THEN 'analyze_text' WHEN 1 THEN 'analyze_text' WHEN 2 THEN 'analyze_image' WHEN 3 THEN 'analyze_audio' WHEN 4 THEN 'compress_image' WHEN 5 THEN 'compress_audio' WHEN 6 THEN 'analyze_image' WHEN 8 THEN 'resize' WHEN 9 THEN 'compress_image' END AS action,
CASE k WHEN 1 THEN 'missing text' WHEN 2 THEN CASE WHEN event_id % 7 = 0 THEN 'invalid image dimensions or file size' END WHEN 3 THEN CASE WHEN event_id % 3 = 0 THEN 'invalid audio sample rate or PCM16 file' END
WHEN 4 THEN CASE WHEN event_id % 24 = 0 OR event_id % 24 % 8 <> 0 THEN 'invalid image compression parameters' END WHEN 5 THEN CASE WHEN event_id % 4 NOT IN (1, 2) THEN 'invalid audio compression parameters' END
WHEN 6 THEN 'missing file_path' WHEN 7 THEN 'missing action' WHEN 8 THEN 'unknown action: resize' WHEN 9 THEN CASE WHEN event_id % 120 NOT BETWEEN 1 AND 100 THEN 'invalid image compression parameters' END END AS error FROM req)"""

_FOLD = lambda v: f"CASE WHEN {v} >= 0 THEN 2 * {v} ELSE -2 * {v} - 1 END"
_WRAP = lambda v: f"(((({v}) + 32768) % 65536 + 65536) % 65536 - 32768)"
_NB = "nb AS (SELECT vec_id, label AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings WHERE len(embedding) = 64)"
_SYMBOLS = f"""{_ZZ}, {_NB}, zf AS (SELECT nb.video_id, n // 4 AS frame_no, n % 4 AS b, k, q, count(*) OVER (PARTITION BY nb.video_id, n // 4) AS c FROM zz JOIN nb ON nb.vec_id = zz.vec_id),
dc AS (SELECT video_id, frame_no, b, {_WRAP("q - lag(q, 1, 0) OVER (PARTITION BY video_id, frame_no ORDER BY b)")} AS d FROM zf WHERE k = 0 AND c = 256),
rl AS (SELECT video_id, frame_no, b, k, k - lag(k, 1, 0) OVER (PARTITION BY video_id, frame_no, b ORDER BY k) - 1 AS run, q FROM zf WHERE k > 0 AND q <> 0 AND c = 256),
sym AS (SELECT video_id, frame_no, b, 0 AS k, printf('%04x', CAST({_FOLD("d")} AS INTEGER)) AS h FROM dc UNION ALL SELECT video_id, frame_no, b, k, printf('%02x', CAST(run AS INTEGER)) || printf('%04x', CAST({_FOLD("q")} AS INTEGER)) FROM rl UNION ALL SELECT video_id, frame_no, b, 64, 'ff' FROM dc)"""
_PAIRS = f"""{_PCM}, st AS (SELECT clip_id || ':' || (i // 256) AS clip_id, i % 256 AS j, s, count(*) OVER (PARTITION BY clip_id, i // 256) AS c FROM pcm),
sd AS (SELECT clip_id, j, c, {_WRAP("s - lag(s, 1, 0) OVER (PARTITION BY clip_id, j % 2 ORDER BY j)")} AS d FROM st)"""
_LOUD = f"{_BPM}, lo AS (SELECT *, bpm > 110 AND confidence > 0.15 AND rms * CASE WHEN clip_id = 'A' THEN 1 ELSE 2 END > 0.8 AS music FROM bpm)"

ORACLES: dict[str, str] = {
    "moderate_text": f"""WITH {_FIRST}, {_SCORE} SELECT s.doc_id, matched_pattern IS NULL AND NOT (is_valid AND score >= 0.5) AS is_safe,
CASE WHEN matched_pattern IS NOT NULL THEN 1.0::DOUBLE WHEN is_valid AND score >= 0.5 THEN round(score, 6) ELSE 0.0::DOUBLE END AS risk_score,
CASE WHEN matched_pattern IS NOT NULL THEN 'PROFANITY_EXACT' WHEN is_valid AND score >= 0.5 AND score >= {NEUTRAL_THRESHOLD} THEN 'PROFANITY_SEMANTIC' ELSE 'NONE' END AS violation_type, matched_pattern FROM score s LEFT JOIN first ON first.doc_id = s.doc_id""",
    "text_normalize": f"WITH {_N} SELECT doc_id, md5(n) AS normalized_md5, CAST(length(n) AS INTEGER) AS n_chars FROM n",
    "text_first_match": f"WITH {_FIRST} SELECT doc_id, matched_pattern FROM first",
    "text_all_matches": f"""WITH {_LEX}, {_N}, parts AS (SELECT doc_id, pattern, string_split(n, pattern) AS p FROM n JOIN lex ON contains(n, pattern)),
occ AS (SELECT doc_id, pattern, unnest(list_transform(range(1, len(p)), lambda i: CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: strlen(x))), 0) AS BIGINT) + (i - 1) * strlen(pattern))) AS start_pos FROM parts)
SELECT doc_id, pattern, start_pos, start_pos + strlen(pattern) AS end_pos FROM occ""",
    "text_contains_any": f"WITH {_FIRST} SELECT n.doc_id, matched_pattern IS NOT NULL AS hit FROM n LEFT JOIN first ON first.doc_id = n.doc_id",
    "text_tokens": f"WITH t AS (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents) SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(coalesce(array_to_string(t, chr(10)), '')) AS tokens_md5 FROM t",
    "semantic_score": f"WITH {_N}, {_SCORE} SELECT doc_id, is_valid, round(score, 6) AS score FROM score",
    "semantic_gate": f"WITH {_N}, {_SCORE} SELECT doc_id, is_valid AND score >= 0.5 AS flagged, CASE WHEN is_valid AND score >= {NEUTRAL_THRESHOLD} THEN 'PROFANITY_SEMANTIC' ELSE 'NONE' END AS category FROM score",
    "lexicon_explode": f"WITH {_LEX} SELECT category, CAST(ordinal AS INTEGER) AS ordinal, pattern FROM lex",
    "ocr_moderate": f"""WITH {_LEX}, n AS (SELECT conv_id || ':' || turn AS image_id, {normalize_sql('text')} AS n FROM conversations),
h AS (SELECT image_id, arg_min(pattern, (instr(n, pattern) + length(pattern)) * 100000 - length(pattern)) AS p FROM n JOIN lex ON contains(n, pattern) GROUP BY 1)
SELECT n.image_id, p IS NOT NULL AS has_violation, p AS matched_pattern FROM n LEFT JOIN h ON h.image_id = n.image_id""",
    "violation_summary": f"""WITH {_FIRST}, d AS (SELECT lang, matched_pattern IS NULL AS is_safe FROM documents d LEFT JOIN first ON first.doc_id = d.doc_id)
SELECT lang, CASE WHEN is_safe THEN 'NONE' ELSE 'PROFANITY_EXACT' END AS violation_type, count(*) AS n, CAST(sum(CASE WHEN is_safe THEN 0 ELSE 1 END) AS BIGINT) AS n_unsafe FROM d GROUP BY 1, 2""",
    "skin_pixels": f"WITH {_SKIN} SELECT image_id, count(*) AS n_pixels, CAST(sum(s) AS BIGINT) AS n_skin FROM skin GROUP BY 1",
    "skin_ratio": f"WITH {_SKIN} SELECT image_id, round(avg(s), 6) AS skin_ratio FROM skin GROUP BY 1",
    "skin_mask": f"WITH {_SKIN} SELECT image_id, string_agg(CAST(s AS VARCHAR), '' ORDER BY k) AS mask FROM skin GROUP BY 1",
    "skin_components": f"WITH RECURSIVE {_COMP} SELECT * FROM comp",
    "exposure_ratio": f"WITH RECURSIVE {_COMP}, im AS (SELECT DISTINCT image_id FROM skin) SELECT im.image_id, round(coalesce(sum(pixel_count) FILTER (pixel_count > 64 // 100), 0) / 64.0::DOUBLE, 6) AS exposure_ratio FROM im LEFT JOIN comp ON comp.image_id = im.image_id GROUP BY 1",
    "moderate_image": f"""WITH {_FIRST}, {_SKIN}, r AS (SELECT image_id, avg(s) AS s FROM skin GROUP BY 1)
SELECT image_id, s < 0.25 AND matched_pattern IS NULL AS is_safe, CASE WHEN matched_pattern IS NOT NULL THEN 1.0::DOUBLE WHEN s >= 0.25 THEN round(least(1.0::DOUBLE, s / 0.25::DOUBLE), 6) ELSE 0.0::DOUBLE END AS risk_score,
CASE WHEN matched_pattern IS NOT NULL THEN 'OCR_PROFANITY' WHEN s >= 0.25 THEN 'EXPLICIT_BODY' ELSE 'NONE' END AS violation_type, round(s, 6) AS skin_ratio FROM r LEFT JOIN first ON first.doc_id = image_id""",
    "audio_corruption": """WITH c AS (SELECT event_type AS clip_id, count(*) AS n_samples, count(*) FILTER ((event_id % 40 = 0 AND length(event_type) % 2 = 0) OR event_id % 400 = 0) AS n_invalid FROM events GROUP BY 1)
SELECT clip_id, n_samples, n_invalid, n_invalid > n_samples // 100 OR n_invalid = n_samples AS is_corrupted FROM c""",
    "audio_rms": f"WITH {_CLIP} SELECT clip_id, round(sqrt(avg(v * v)), 6) AS rms FROM clip GROUP BY 1",
    "audio_dft": f"""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
w AS (SELECT vec_id, k, v * 0.5 * (1 - cos(2 * pi() * k / 63)) AS v FROM e)
SELECT vec_id, CAST(f AS INTEGER) AS bin, round(sqrt(pow(sum(v * cos(2 * pi() * f * k / 64)), 2) + pow(sum(v * sin(2 * pi() * f * k / 64)), 2)), 4) AS magnitude FROM w, range(33) r(f) GROUP BY 1, 2""",
    "spectral_centroid": f"""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
w AS (SELECT vec_id, k, v * 0.5 * (1 - cos(2 * pi() * k / 63)) AS v FROM e),
m AS (SELECT vec_id, f, sqrt(pow(sum(v * cos(2 * pi() * f * k / 64)), 2) + pow(sum(v * sin(2 * pi() * f * k / 64)), 2)) AS m FROM w, range(1, 33) r(f) GROUP BY 1, 2)
SELECT vec_id, round(CASE WHEN sum(m) > 1e-6 THEN sum(f * ({PCM_RATE} / 64.0::DOUBLE) * m) / sum(m) ELSE 0.0::DOUBLE END, 3) AS centroid FROM m GROUP BY 1""",
    "onset_envelope": f"WITH {_ENV} SELECT clip_id, frame, round(flux, 6) AS flux FROM env",
    "autocorrelation": f"WITH {_AC} SELECT clip_id, lag, round(value, 6) AS value FROM ac",
    "bpm_detect": f"WITH {_BPM} SELECT clip_id, round(bpm, 4) AS bpm, round(confidence, 6) AS confidence, bpm > 110 AND confidence > 0.15 AS music_detected FROM bpm",
    "moderate_audio": f"""WITH {_BPM}, m AS (SELECT *, bpm > 110 AND confidence > 0.15 AS music FROM bpm)
SELECT clip_id, NOT music AS is_safe, CASE WHEN music THEN round(confidence, 6) ELSE 0.0::DOUBLE END AS risk_score, CASE WHEN music THEN 'MUSIC_DETECTED' ELSE 'NONE' END AS violation_type, music AS flagged, false AS corrupted, round(bpm, 4) AS bpm FROM m""",
    "pcm16_to_float": f"WITH {_PCM} SELECT clip_id || ':' || (i // 256) AS clip_id, i % 256 AS i, s / 32768.0::DOUBLE AS v FROM pcm",
    "quant_table": f"""WITH {_QT} SELECT CAST(quality AS INTEGER) AS quality, k, CAST(greatest(1, least(255, (q * (CASE WHEN quality < 50 THEN 5000 // quality ELSE 200 - 2 * quality END) + 50) // 100)) AS INTEGER) AS q FROM qt, (VALUES (1), (10), (49), (50), (75), (100)) s(quality)""",
    "image_blocks": f"WITH {_BLOCK} SELECT vec_id, k, px - 128 AS v FROM blk",
    "dct_forward": f"WITH {_DCT} SELECT vec_id, k, c + 0.0::DOUBLE AS c FROM dct",
    "dct_quantize": f"WITH {_QUANT} SELECT vec_id, k, v AS q FROM quant",
    "zigzag": f"WITH {_ZZ} SELECT vec_id, k, q FROM zz",
    "zigzag_int": "WITH v AS (SELECT event_id, CAST(event_id * 7919 % 65536 - 32768 AS INTEGER) AS v FROM events) SELECT event_id, v, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS folded, v AS unfolded FROM v",
    "dc_delta": f"WITH {_ZZ} SELECT vec_id, CAST((((q - lag(q, 1, 0) OVER (PARTITION BY label ORDER BY vec_id)) + 32768) % 65536 + 65536) % 65536 - 32768 AS INTEGER) AS dc_delta FROM zz WHERE k = 0",
    "ac_rle": f"""WITH {_ZZ} SELECT vec_id, CAST(row_number() OVER w - 1 AS INTEGER) AS n, CAST(k - lag(k, 1, 0) OVER w - 1 AS INTEGER) AS run, q AS value FROM zz WHERE k > 0 AND q <> 0 WINDOW w AS (PARTITION BY vec_id ORDER BY k)""",
    "dct_inverse": f"WITH {_INV} SELECT vec_id, k, v + 0.0::DOUBLE AS v FROM inv",
    "image_reconstruct": f"WITH {_REC} SELECT vec_id, k, px FROM rec",
    "audio_dpcm": f"""WITH {_PCM}, r AS (SELECT clip_id, i, CAST((((s - lag(s, 1, 0) OVER (PARTITION BY clip_id ORDER BY i)) + 32768) % 65536 + 65536) % 65536 - 32768 AS INTEGER) AS residual FROM pcm)
SELECT clip_id, i, residual, CASE WHEN residual >= 0 THEN 2 * residual ELSE -2 * residual - 1 END AS folded FROM r""",
    "motion_search": f"WITH {_FRAMES} SELECT video_id, frame_no, CAST(block AS INTEGER) AS block, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, CAST(sad AS BIGINT) AS sad FROM mv",
    "motion_residual": f"""WITH {_FRAMES} SELECT mv.video_id, mv.frame_no, CAST(block AS INTEGER) AS block, CAST((n.y % 8) * 8 + n.x % 8 AS INTEGER) AS k, n.px - o.px AS residual
FROM mv JOIN f n ON n.video_id = mv.video_id AND n.frame_no = mv.frame_no AND (n.y // 8) * 2 + n.x // 8 = block JOIN f o ON o.video_id = mv.video_id AND o.frame_no = mv.frame_no - 1 AND o.x = n.x + dx AND o.y = n.y + dy""",
    "ac_roundtrip": f"WITH {_BYTES} SELECT clip_id, length(h) // 2 AS n_bytes, md5(unhex(h)) AS md5, true AS same FROM hex",
    "image_roundtrip": f"WITH {_REC} SELECT vec_id, string_agg(printf('%02x', px), '' ORDER BY k) AS px_hex FROM rec GROUP BY 1",
    "audio_roundtrip": f"WITH {_BYTES} SELECT clip_id, length(h) // 2 AS n_bytes, md5(unhex(h)) AS md5 FROM hex",
    "request_route": f"WITH {_REQ} SELECT * FROM route",
    "request_errors": f"WITH {_REQ} SELECT error, count(*) AS n FROM route WHERE error IS NOT NULL GROUP BY 1",
    "requests_stream": f"WITH {_REQ} SELECT * FROM route",
    "report_json": f"""WITH {_FIRST} SELECT n.doc_id, '{{"status":"success","result":{{"is_safe":' || CASE WHEN matched_pattern IS NULL THEN 'true,"risk_score":0.0,"violation_type":"NONE"' ELSE 'false,"risk_score":1.0,"violation_type":"PROFANITY_EXACT"' END || ',"matched_pattern":"' || coalesce(matched_pattern, '') || '"}}}}' AS response FROM n LEFT JOIN first ON first.doc_id = n.doc_id""",
    "error_messages": "SELECT * FROM (VALUES " + ", ".join(f"({_q(a)}, {_q(b)})" for a, b in ERRORS.items()) + ") v(error, message)",
    "model_vocab": "SELECT * FROM (VALUES " + ", ".join(f"({_q(w)}, {_q(','.join(map(str, v)))}, CAST({NEUTRAL_THRESHOLD} AS DOUBLE))" for w, v in WORDS.items()) + ") v(word, weights, threshold)",
    "media_files": "SELECT 'clip_' || k || '.pcm' AS name, k * 10 + 10 AS length, md5(unhex(coalesce((SELECT string_agg(printf('%02x', CAST(b AS INTEGER)), '' ORDER BY b) FROM range(k * 10 + 10) r(b)), ''))) AS md5 FROM range(5) q(k)",
    "text_token_retry": f"""WITH {_LEX}, {_N}, t AS (SELECT doc_id, unnest({_TOKENS.format('n')}) AS t FROM n), h AS (SELECT DISTINCT doc_id FROM n JOIN lex ON contains(n, pattern)), k AS (SELECT DISTINCT doc_id FROM t JOIN lex ON contains(t, pattern))
SELECT n.doc_id, h.doc_id IS NOT NULL AS hit, k.doc_id IS NOT NULL AS token_hit FROM n LEFT JOIN h ON h.doc_id = n.doc_id LEFT JOIN k ON k.doc_id = n.doc_id""",
    "lexicon_status": f"WITH {_LEX} SELECT name, loaded, CASE WHEN name = 'good' THEN (SELECT count(*) FROM lex) ELSE 0 END AS n_patterns FROM (VALUES ('good', true), ('malformed', true), ('missing', false), ('folder', false), ('empty', false)) v(name, loaded)",
    "lexicon_keywords": f"WITH {_LEX}, a AS (SELECT category, pattern FROM lex UNION ALL VALUES ('ADDED', 'more'), ('ADDED', 'yet more')) SELECT category, count(*) AS n, string_agg(DISTINCT pattern, '|' ORDER BY pattern) AS patterns FROM a GROUP BY 1",
    "moderate_image_moderate": f"""WITH {_FIRST}, {_SKIN}, r AS (SELECT image_id, avg(s) AS s FROM skin GROUP BY 1)
SELECT image_id, s < 0.45 AND matched_pattern IS NULL AS is_safe, CASE WHEN matched_pattern IS NOT NULL THEN 1.0::DOUBLE WHEN s >= 0.45 THEN round(least(1.0::DOUBLE, s / 0.45::DOUBLE), 6) ELSE 0.0::DOUBLE END AS risk_score,
CASE WHEN matched_pattern IS NOT NULL THEN 'OCR_PROFANITY' WHEN s >= 0.45 THEN 'EXPLICIT_BODY' ELSE 'NONE' END AS violation_type, round(s, 6) AS skin_ratio FROM r LEFT JOIN first ON first.doc_id = image_id""",
    "blob_skin_ratio": f"WITH {_SKIN} SELECT image_id, CASE WHEN image_id % 11 = 10 OR image_id % 10 = 9 THEN 0.0::DOUBLE ELSE round(avg(s), 6) END AS skin_ratio, CASE WHEN image_id % 10 = 9 AND image_id % 11 <> 10 THEN 'InvalidInput' END AS error FROM skin GROUP BY 1",
    "moderate_audio_corrupted": """WITH c AS (SELECT event_type AS clip_id, count(*) AS n, count(*) FILTER ((event_id % 40 = 0 AND length(event_type) % 2 = 0) OR event_id % 400 = 0) AS bad FROM events GROUP BY 1)
SELECT clip_id, false AS is_safe, 0.0::DOUBLE AS risk_score, 'CORRUPTED_AUDIO' AS violation_type, false AS flagged, true AS corrupted, 0.0::DOUBLE AS bpm FROM c WHERE bad > n // 100 OR bad = n""",
    "moderate_audio_moderate": f"""WITH {_LOUD} SELECT clip_id, NOT music AS is_safe, CASE WHEN music THEN round(confidence, 6) ELSE 0.0::DOUBLE END AS risk_score, CASE WHEN music THEN 'HIGH_ENERGY_AUDIO' ELSE 'NONE' END AS violation_type, music AS flagged, false AS corrupted, round(bpm, 4) AS bpm FROM lo""",
    "image_symbols": f"WITH {_SYMBOLS}, j AS (SELECT video_id, frame_no, string_agg(h, '' ORDER BY b, k) AS h FROM sym GROUP BY 1, 2) SELECT video_id, frame_no, length(h) // 2 AS n_symbols, md5(unhex(h)) AS md5 FROM j",
    "image_blocks_roundtrip": f"""WITH {_REC}, {_NB}, p AS (SELECT nb.video_id, n // 4 AS frame_no, (n % 4 // 2) * 8 + k // 8 AS y, (n % 2) * 8 + k % 8 AS x, px, count(*) OVER (PARTITION BY nb.video_id, n // 4) AS c FROM rec JOIN nb ON nb.vec_id = rec.vec_id)
SELECT video_id * 1000000 + frame_no AS frame_id, string_agg(printf('%02x', px), '' ORDER BY y, x) AS px_hex FROM p WHERE c = 256 GROUP BY 1""",
    "audio_symbols": f"WITH {_PAIRS}, j AS (SELECT clip_id, string_agg(printf('%04x', CAST({_FOLD('d')} AS INTEGER)), '' ORDER BY j) AS h FROM sd WHERE j < c // 2 * 2 GROUP BY 1) SELECT clip_id, length(h) // 2 AS n_symbols, md5(unhex(h)) AS md5 FROM j",
    "audio_stereo_roundtrip": f"WITH {_BYTES} SELECT clip_id, CASE WHEN length(h) % 8 = 0 THEN length(h) // 2 END AS n_bytes, CASE WHEN length(h) % 8 = 0 THEN md5(unhex(h)) END AS md5, CASE WHEN length(h) % 8 <> 0 THEN 'InvalidInput' END AS error FROM hex",
    "bit_stream": """SELECT event_id, printf('%08x', CAST((((event_id % 8) * 8192 + event_id * 7919 % 8192) * 2 + event_id % 2) * 256 + event_id % 256 AS BIGINT) * 128) AS hex, event_id % 8 AS a, event_id * 7919 % 8192 AS b, event_id % 2 AS c, 4 AS n_bytes, CASE WHEN 10 + event_id % 10 > 16 THEN 'Overflow' END AS error FROM events""",
    "serve": f"""WITH {_REQ} SELECT request_id, CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status, error AS message,
CASE WHEN error IS NULL AND action LIKE 'analyze%' THEN CASE WHEN action = 'analyze_text' THEN 'false' ELSE 'true' END END AS is_safe, CASE WHEN error IS NULL AND action LIKE 'analyze%' THEN CASE WHEN action = 'analyze_text' THEN 'PROFANITY_EXACT' ELSE 'NONE' END END AS violation_type,
CASE WHEN error IS NULL AND action LIKE 'compress%' THEN 'true' END AS is_completed, CASE WHEN error IS NULL AND action LIKE 'compress%' THEN CASE request_id % 10 WHEN 4 THEN 16 * (request_id % 24) WHEN 5 THEN 8 ELSE 64 END END AS original_size, error IS NULL AND coalesce(action LIKE 'compress%', false) AS has_size FROM route""",
}
