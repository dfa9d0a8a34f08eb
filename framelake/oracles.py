"""SQL twins of the queries, for an independent engine over the same tables."""

from __future__ import annotations

HOUR = 3_600_000_000
DAY = 24 * HOUR

_EV = """ev AS (
  SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, value,
         CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INT) AS k,
         coalesce(TRY_CAST(round(value * 100) AS BIGINT), 0) & 65535 AS cents,
         CASE event_type WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS code,
         CASE event_type WHEN 'signup' THEN 104 WHEN 'click' THEN 106 WHEN 'error' THEN 111 ELSE 107 END AS state,
         'can' || CAST(user_id % 5 AS VARCHAR) AS iface
  FROM events)"""

_FR = """fr AS (
  SELECT *, 256 + user_id AS arb_id, 256 + code AS typed_id, CASE WHEN k >= 10 THEN 4 ELSE 3 END AS dlc,
         printf('%02X%04X', code, cents) || CASE WHEN k >= 10 THEN printf('%02X', k) ELSE '' END AS hx,
         code AS b0, cents // 256 AS b1, cents % 256 AS b2, CASE WHEN k >= 10 THEN k END AS b3
  FROM ev)"""

_BY = """bt AS (
  SELECT iface, arb_id, typed_id, event_id, ts_us, dlc, 0 AS byte_index, b0 AS value FROM fr
  UNION ALL SELECT iface, arb_id, typed_id, event_id, ts_us, dlc, 1, b1 FROM fr
  UNION ALL SELECT iface, arb_id, typed_id, event_id, ts_us, dlc, 2, b2 FROM fr
  UNION ALL SELECT iface, arb_id, typed_id, event_id, ts_us, dlc, 3, b3 FROM fr WHERE b3 IS NOT NULL)"""

# payloads of 3 to 64 bytes: bl is the list of all byte values
_LF = """fr AS (
  SELECT *, 256 + user_id AS arb_id, 256 + code AS typed_id, CAST(len(bl) AS INT) AS dlc,
         array_to_string(list_transform(bl, lambda x: printf('%02X', x)), '') AS hx
  FROM (SELECT *, list_concat([code, cents // 256, cents % 256], CASE WHEN k >= 10 THEN list_concat([CAST(k AS BIGINT)],
          list_transform(range(4, 4 + CASE WHEN code = 2 THEN 8 WHEN k >= 90 THEN (k - 89) * 6 ELSE 0 END), lambda j: (cents + j * 7) % 256)) ELSE CAST([] AS BIGINT[]) END) AS bl
        FROM ev))"""

_LBY = """bt AS (
  SELECT iface, arb_id, typed_id, event_id, ts_us, dlc, CAST(byte_index AS INT) AS byte_index, bl[byte_index + 1] AS value
  FROM (SELECT *, unnest(range(len(bl))) AS byte_index FROM fr))"""

_LSERIES = """series AS (
  SELECT iface, typed_id, event_id, ts_us, unnest([
    {'kind': 'u8', 'offset': i, 'x': bl[i + 1]}, {'kind': 'u16le', 'offset': i, 'x': bl[i + 1] + bl[i + 2] * 256},
    {'kind': 'u16be', 'offset': i, 'x': bl[i + 1] * 256 + bl[i + 2]}]) AS s
  FROM (SELECT *, unnest(range(len(bl))) AS i FROM SRC))"""

_LBITS = """bits AS (
  SELECT iface, typed_id, event_id, ts_us, dlc, {'byte_index': i // 8, 'bit_index': i % 8, 'bit': (bl[i // 8 + 1] >> (i % 8)) & 1} AS s
  FROM (SELECT *, CAST(unnest(range(len(bl) * 8)) AS INT) AS i FROM fr))"""

_IDS = "[512, 514, 516, 518, 528, 530, 770, 772, 782, 1120, 776, 552, 1516, 241, 497, 711]"
_VF = f"""vf AS (
  SELECT *, CASE WHEN arb_id = 1516 THEN 254 ELSE k END AS c0, CASE WHEN arb_id = 1516 THEN state ELSE cents // 256 END AS c1,
         cents % 256 AS c2, code AS c3, user_id % 256 AS c4, (k * 7) % 256 AS c5, (cents * 3) % 256 AS c6, (user_id * 5) % 256 AS c7
  FROM (SELECT *, list_extract({_IDS}, CAST(user_id % 16 + 1 AS INT)) AS arb_id FROM ev))"""

_BF = """bf AS (
  SELECT *, CASE WHEN event_id % 3 = 0 THEN 2016 + event_id % 16 ELSE 1120 + event_id % 32 END AS bid FROM vf)"""

_DM = """dm AS (
  SELECT *, CASE WHEN event_type IN ('signup', 'purchase') THEN 2016 ELSE 2024 END + user_id % 3 AS can_id,
         CASE event_type
           WHEN 'signup' THEN '22F1' || printf('%02X', k // 10)
           WHEN 'click' THEN '62F1' || printf('%02X', k // 10) || printf('%04X', cents)
           WHEN 'error' THEN '7F22' || CASE WHEN k < 50 THEN '78' ELSE '31' END
           WHEN 'purchase' THEN '27' || printf('%02X', k) || printf('%04X', cents)
           ELSE '67' || printf('%02X', k) || printf('%04X', cents) END AS payload,
         CASE WHEN event_type IN ('signup', 'purchase') THEN 'request' WHEN event_type = 'error' THEN 'negativeResponse'
              ELSE 'positiveResponse' END AS direction,
         CASE WHEN event_type IN ('purchase', 'view') THEN 'SecurityAccess' ELSE 'ReadDataByIdentifier' END AS service,
         CASE WHEN event_type IN ('purchase', 'view') THEN '0x27' ELSE '0x22' END AS service_id,
         CASE WHEN event_type = 'error' THEN CASE WHEN k < 50 THEN 'responsePending' ELSE 'requestOutOfRange' END END AS nrc_name
  FROM ev)"""


def _with(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body


_CHANGED = "CASE WHEN lag({v}) OVER w IS NOT NULL AND lag({v}) OVER w != {v} THEN 1 ELSE 0 END"

_BYTE_METRICS = f"""bm AS (
  SELECT iface, arb_id, byte_index, count(*) AS observation_count, count(DISTINCT value) AS distinct_values, min(value) AS minimum_value,
         max(value) AS maximum_value, CAST(sum(ch) AS BIGINT) AS change_count
  FROM (SELECT *, {_CHANGED.format(v='value')} AS ch FROM bt WINDOW w AS (PARTITION BY iface, arb_id, byte_index ORDER BY ts_us, event_id))
  GROUP BY ALL)"""

_ID_METRICS = f"""im AS (
  SELECT 'events' AS session_id, f.iface, f.arb_id, f.frame_count, f.first_us / 1e6 AS first_ts, f.last_us / 1e6 AS last_ts,
         CASE WHEN frame_count > 1 THEN (last_us - first_us) / 1e3 / (frame_count - 1) END AS mean_period_ms,
         f.transition_count, b.changing AS changing_byte_count,
         1e2 * f.transition_count / greatest(f.frame_count - 1, 1) + b.diversity + b.changing * 5 AS activity_score
  FROM (SELECT iface, arb_id, count(*) AS frame_count, min(ts_us) AS first_us, max(ts_us) AS last_us, CAST(sum(ch) AS BIGINT) AS transition_count
        FROM (SELECT *, {_CHANGED.format(v='hx')} AS ch FROM fr WINDOW w AS (PARTITION BY iface, arb_id ORDER BY ts_us, event_id)) GROUP BY ALL) f
  JOIN (SELECT iface, arb_id, CAST(sum(CASE WHEN distinct_values > 1 THEN 1 ELSE 0 END) AS BIGINT) AS changing,
               CAST(sum(least(distinct_values - 1, 32)) AS BIGINT) AS diversity FROM bm GROUP BY ALL) b USING (iface, arb_id))"""

_DOMINANT = """dom AS (
  SELECT iface, arb_id, dlc AS dominant_dlc FROM (
    SELECT iface, arb_id, dlc, row_number() OVER (PARTITION BY iface, arb_id ORDER BY count(*) DESC, min(ts_us)) AS r
    FROM fr GROUP BY iface, arb_id, dlc) WHERE r = 1)"""

# the "five interfaces as five sessions of one bus" view, reduced to its dominant lengths
_BUS = """bus AS (
  SELECT f.* FROM fr f JOIN (
    SELECT typed_id, dlc FROM (
      SELECT typed_id, dlc, row_number() OVER (PARTITION BY typed_id ORDER BY sum(n) DESC, min(struct_pack(i := iface, t := t))) AS r FROM (
        SELECT typed_id, dlc, iface, count(*) AS n, min(ts_us) AS t FROM fr GROUP BY ALL) GROUP BY typed_id, dlc) WHERE r = 1) d
  USING (typed_id, dlc))"""

_SERIES = """series AS (
  SELECT iface, typed_id, event_id, ts_us, unnest([
    {'kind': 'u8', 'offset': 0, 'x': b0}, {'kind': 'u8', 'offset': 1, 'x': b1}, {'kind': 'u8', 'offset': 2, 'x': b2}, {'kind': 'u8', 'offset': 3, 'x': b3},
    {'kind': 'u16le', 'offset': 0, 'x': b0 + b1 * 256}, {'kind': 'u16be', 'offset': 0, 'x': b0 * 256 + b1},
    {'kind': 'u16le', 'offset': 1, 'x': b1 + b2 * 256}, {'kind': 'u16be', 'offset': 1, 'x': b1 * 256 + b2},
    {'kind': 'u16le', 'offset': 2, 'x': b2 + b3 * 256}, {'kind': 'u16be', 'offset': 2, 'x': b2 * 256 + b3}]) AS s FROM SRC)"""

_ANN = "ann AS (SELECT event_id AS annotation_idx, iface, ts_us AS start_us, ts_us + {end} AS end_us FROM ev WHERE event_type = 'error')"


def _correlation(end: str, score: str, order: str) -> str:
    return _with(
        _EV, _LF, _LBY, _ANN.format(end=end),
        f"""hist AS (
  SELECT annotation_idx, iface, typed_id AS arb_id, byte_index, value, sum(CASE WHEN ts_us < start_us THEN 1 ELSE 0 END) AS b,
         sum(CASE WHEN ts_us >= start_us THEN 1 ELSE 0 END) AS a
  FROM bt JOIN ann USING (iface) WHERE ts_us >= start_us - {6 * HOUR} AND ts_us < end_us GROUP BY ALL)""",
        """tot AS (
  SELECT annotation_idx, iface, arb_id, byte_index, sum(b) AS nb, sum(a) AS na, sum(value * b) / CAST(sum(b) AS DOUBLE) AS mb,
         sum(value * a) / CAST(sum(a) AS DOUBLE) AS ma FROM hist GROUP BY ALL HAVING sum(b) >= 3 AND sum(a) >= 3)""",
        """sc AS (
  SELECT t.*, d.gap / (CAST(nb AS DOUBLE) * na) / 2 AS distance FROM tot t JOIN (
    SELECT annotation_idx, iface, arb_id, byte_index, sum(abs(b * CAST(na AS DOUBLE) - a * CAST(nb AS DOUBLE))) AS gap
    FROM hist JOIN tot USING (annotation_idx, iface, arb_id, byte_index) GROUP BY ALL) d USING (annotation_idx, iface, arb_id, byte_index))""",
        f"sd AS (SELECT *, {score} AS score FROM (SELECT *, 100.0 * distance + 20.0 * abs(ma - mb) / 255 AS s0 FROM sc))",
        body=f"""SELECT iface AS session_id, annotation_idx, rank, 'bus' AS iface, arb_id, byte_index, CAST(nb AS BIGINT) AS n_base, CAST(na AS BIGINT) AS n_action,
       round(mb, 6) AS mean_base, round(ma, 6) AS mean_action, round(distance, 6) AS distance, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY iface, annotation_idx ORDER BY {order}) AS rank FROM sd) WHERE rank <= 8""",
    )


_RUNS = """runs AS (
  SELECT * FROM (SELECT 'u' || user_id AS channel, event_id AS seq, ts_us, state AS raw_state, {part} AS day,
                        lag(state) OVER (PARTITION BY user_id, {part} ORDER BY ts_us, event_id) AS p FROM ev)
  WHERE p IS NULL OR p != raw_state)"""

_DAY = f"ts_us // {DAY}"
_FACTS = """facts AS (
  SELECT channel, day, count(*) AS runs, list(raw_state ORDER BY ts_us, seq) AS l, min(CASE WHEN raw_state = 106 THEN ts_us END) AS fm,
         min(CASE WHEN raw_state = 111 THEN ts_us END) AS pc, min(CASE WHEN raw_state = 107 THEN ts_us END) AS es FROM runs GROUP BY channel, day)"""
_CLASS = """CASE WHEN l = [104, 106, 111, 107] THEN 'successfulStartup' WHEN l = [107, 106, 104] THEN 'normalShutdown'
  WHEN l[1] = 104 AND l[-1] = 104 THEN 'stableHvOff' WHEN l[1] = 107 AND l[-1] = 107 THEN 'stableHvEstablished' ELSE 'unknownOrIncomplete' END"""


def _assessed(windows: str) -> str:
    return f"""volt AS (
  SELECT w.channel, w.day, w.pc, w.es, count(v.ts_us) AS n, min_by(v.dc, v.ts_us) AS start_dc, max(v.dc) AS max_dc, max(v.pack) AS max_pack, max(v.dc / v.pack) AS best_ratio
  FROM {windows} w LEFT JOIN (SELECT 'u' || user_id AS channel, {_DAY} AS day, ts_us, 300.0 + k AS pack, cents / 50.0 AS dc FROM ev) v
    ON v.channel = w.channel AND v.day = w.day AND v.ts_us >= w.pc AND (w.es IS NULL OR v.ts_us <= w.es) GROUP BY ALL),
vv AS (SELECT channel, day, n AS voltage_samples, CASE WHEN n >= 2 THEN start_dc END AS start_dc, CASE WHEN n >= 2 THEN max_dc END AS max_dc,
              CASE WHEN n >= 2 THEN max_pack END AS max_pack, CASE WHEN n >= 2 THEN best_ratio END AS best_ratio,
              CASE WHEN pc IS NULL THEN 'notEvaluated' WHEN n < 2 THEN 'insufficientData' WHEN best_ratio >= 0.9 THEN 'converged'
                   WHEN max_dc - start_dc < 20 THEN 'failedToRise' ELSE 'roseButDidNotConverge' END AS voltage_result FROM volt)"""


_SIG = "SELECT event_id AS sequence, arb_id, {sig} AS signal, {slot} AS slot, {value} AS value, {text} AS text FROM {src} WHERE {cond}"


def _sig(sig: str, value: str, cond: str, slot: str = "-1", text: str = "NULL", src: str = "vf") -> str:
    return _SIG.format(sig=f"'{sig}'", slot=slot, value=f"round(CAST({value} AS DOUBLE), 6)", text=text, src=src, cond=cond)


def _hv() -> str:
    parts = []
    for i, raw in enumerate(("((c0 & 31) << 7) | (c1 >> 1)", "((c2 & 31) << 7) | (c3 >> 1)", "(c4 << 4) | (c5 >> 4)")):
        parts.append(_sig("cellVoltage", f"({raw}) * 0.00125", "arb_id IN (512, 514, 516, 518)", slot=f"((arb_id - 512) // 2) * 24 + (c6 >> 5) * 3 + {i + 1}"))
    parts.append(_sig("packVoltage", "((c0 << 4) | (c1 >> 4)) * 0.125", "arb_id = 528"))
    parts.append(_sig("packCurrent", "CASE WHEN c2 >= 128 THEN c2 - 256 ELSE c2 END * 0.1 - 0.1", "arb_id = 528"))
    parts.append(_sig("hvCurrent", "((c0 << 5) | (c1 >> 3)) * 0.05", "arb_id = 530"))
    parts.append(_sig("hvVoltage", "(((c1 & 7) << 7) | (c2 >> 1)) * 0.5", "arb_id = 530"))
    parts.append(_sig("lvCurrent", "(((c2 & 1) << 7) | (c3 >> 1)) * 0.2", "arb_id = 530"))
    parts.append(_sig("lvVoltage", "(((c3 & 1) << 7) | (c4 >> 1)) * 0.1", "arb_id = 530"))
    for i in range(6):
        parts.append(_sig("batteryTemperature", f"c{i + 1} * 0.5 - 40", "arb_id = 770 AND (c0 >> 2) & 1 = 0", slot=str(i + 1)))
    for i in range(3):
        parts.append(_sig("batteryTemperature", f"c{i + 1} * 0.5 - 40", "arb_id = 770 AND (c0 >> 2) & 1 = 1", slot=str(i + 7)))
    parts.append(_sig("requestedCurrent", "c1 * 0.05", "arb_id = 772", text="'validOnlyWhileModeEnabled'"))
    parts.append(_sig("requestedVoltage", "(c2 * 256 + c3) * 0.5", "arb_id = 772", text="'validOnlyWhileModeEnabled'"))
    mode = "CASE c0 WHEN 0 THEN 'disabled' WHEN 1 THEN 'lv12VOnly' WHEN 2 THEN 'hvOnly' WHEN 3 THEN 'hvAndLv12V' ELSE 'unknown' END"
    parts.append(_sig("chargerMode", "c0", "arb_id = 782", text=mode))
    parts.append(_sig("coolantInlet", "(((c0 & 3) << 8) | c1) * 0.125 - 40", "arb_id = 1120"))
    parts.append(_sig("coolantOutlet", "(((c2 & 3) << 8) | c3) * 0.125 - 40", "arb_id = 1120"))
    whole = "printf('%02X%02X%02X%02X%02X%02X%02X%02X', c0, c1, c2, c3, c4, c5, c6, c7)"
    parts.append(_sig("ambiguousRaw", "NULL", "arb_id IN (776, 778)", text=whole))
    return _with(_EV, _VF, body="\nUNION ALL ".join(parts))


def _bicm() -> str:
    slot = "CASE WHEN bid - 1120 >= 16 THEN (bid - 1136) * 2 + 1 ELSE (bid - 1120) * 2 END"
    pair = lambda i: f"((c{2 * i} & 15) * 256 + c{2 * i + 1})"
    src = "(SELECT * REPLACE (bid AS arb_id) FROM bf)"
    parts = [_sig("moduleVoltage", f"{pair(i)} * 0.00125", "bid < 1280", slot=slot, text=f"'{i}'", src=src) for i in range(3)]
    parts.append(_sig("moduleTemperature", f"110.7 - {pair(0)} * 0.0294", "bid - 2016 IN (0, 1, 8, 12, 13)", slot="bid - 2016", src=src))
    parts.append(_sig("moduleTemperature", f"110.7 - {pair(1)} * 0.0294", "bid - 2016 IN (2, 5, 9)", slot="bid - 2016", src=src))
    return _with(_EV, _VF, _BF, body="\nUNION ALL ".join(parts))


_AMPS = "(CASE WHEN ((c1 & 31) << 8 | c2) >= 4096 THEN ((c1 & 31) << 8 | c2) - 8192 ELSE ((c1 & 31) << 8 | c2) END) * 0.15"
_VOLTS = "((c3 << 4) | (c4 >> 4)) * 0.125"

_START = f"""st AS (
  SELECT (SELECT min(ts_us) FROM vf) AS t0, (SELECT max(ts_us) FROM vf WHERE iface IN ('can2', 'can3')) AS hs,
         (SELECT min(ts_us) FROM vf WHERE arb_id = 241 AND c1 > 0) AS motion, (SELECT min_by(c1, ts_us) FROM vf WHERE arb_id = 241 AND c1 > 0) AS motion_raw,
         (SELECT min(ts_us) FROM vf WHERE arb_id = 241 AND c0 & 2 > 0) AS pressed, (SELECT min(ts_us) FROM vf WHERE arb_id = 497 AND c0 & 3 = 3) AS crank),
st2 AS (
  SELECT *, (SELECT min(ts_us) FROM vf WHERE arb_id = 497 AND c0 & 3 = 2 AND ts_us > crank) AS run,
         (SELECT min(ts_us) FROM vf WHERE arb_id = 711 AND abs({_AMPS}) >= 2 AND ts_us >= crank) AS hv FROM st)"""

_ISO_HEX = "list_aggregate(list_transform(range(0, {n}), lambda j: printf('%02X', (event_id + {map}) % 256)), 'string_agg', '')"


def _isotp(check: bool) -> str:
    # the last wire frame of an event: one first frame plus its consecutive frames, less or more one by fault
    cfs = "CASE WHEN n <= 7 THEN 0 ELSE CAST(ceil((n - 6) / 7.0) AS INT) END"
    ok = "n <= 7 OR (fault != 0 AND (fault != 1 OR n <= 13))" if check else "n <= 7 OR fault != 0"
    # a frame sent twice shifts everything behind it by seven bytes, and the message ends one frame earlier or in place
    shifted = "CASE WHEN fault = 1 AND n > 13 AND j >= 13 THEN j - 7 ELSE j END"
    done = f"event_id * 32 + CASE WHEN n > 7 AND n <= 13 THEN 1 ELSE {cfs} END"
    body = f"""SELECT iface, 256 + user_id AS arb_id, ts_us, {done} AS completion_seq,
       {_ISO_HEX.format(n='n', map=shifted)} AS payload
FROM (SELECT *, k + 1 AS n, cents % 7 AS fault FROM ev) WHERE {ok}"""
    return _with(_EV, body=body)


_REFS = """refs(catalog_id, confidence, module, role, can_id) AS (VALUES
  ('catalogA', 'legacyReference', 'M0', 'request', 2016), ('catalogA', 'legacyReference', 'M1', 'request', 2017), ('catalogA', 'legacyReference', 'M2', 'request', 2018),
  ('catalogA', 'legacyReference', 'M0', 'normalResponse', 2024), ('catalogA', 'legacyReference', 'M1', 'normalResponse', 2025),
  ('catalogA', 'legacyReference', 'M2', 'normalResponse', 2026), ('catalogB', 'candidate', 'M9', 'normalResponse', 2026))"""

# module of a response: 2026 also belongs to M9, but M9 has no requests
_TX = """ops AS (SELECT *, 'M' || (user_id % 3) AS module, direction = 'request' AS asks FROM dm),
turns AS (SELECT *, sum(CAST(asks AS INT)) OVER (PARTITION BY iface, module, service ORDER BY ts_us, event_id) AS turn FROM ops),
heads AS (SELECT iface, module, service, turn, ts_us AS req_us, can_id AS req_id FROM turns WHERE asks),
stops AS (SELECT iface, module, service, turn, min(struct_pack(t := ts_us, e := event_id)) AS stop FROM turns
          WHERE NOT asks AND nrc_name IS DISTINCT FROM 'responsePending' GROUP BY ALL),
kept AS (SELECT t.* FROM turns t LEFT JOIN stops s USING (iface, module, service, turn)
         WHERE NOT asks AND turn > 0 AND (s.stop IS NULL OR struct_pack(t := ts_us, e := event_id) <= s.stop)),
tx AS (SELECT h.iface AS channel, h.module, h.service, req_us / 1e6 AS request_ts, req_id AS request_can_id, count(k.ts_us) AS response_count,
              (min_by(k.ts_us, struct_pack(t := k.ts_us, e := k.event_id)) - req_us) / 1000.0 AS initial_latency_ms,
              (max_by(k.ts_us, struct_pack(t := k.ts_us, e := k.event_id)) - req_us) / 1000.0 AS final_latency_ms,
              max_by(k.direction, struct_pack(t := k.ts_us, e := k.event_id)) AS final_direction, count(k.ts_us) = 0 AS unanswered
       FROM heads h LEFT JOIN kept k USING (iface, module, service, turn) GROUP BY h.iface, h.module, h.service, h.turn, req_us, req_id)"""

_TRAFFIC = """traffic AS (
  SELECT 'events' AS session_id, iface AS channel, can_id, module, role, confidence, count(*) AS frame_count,
         min_by(ts_us, event_id) / 1e6 AS first_ts, max_by(ts_us, event_id) / 1e6 AS last_ts FROM dm JOIN refs USING (can_id) GROUP BY ALL)"""

_TR = """calls AS (
  SELECT *, 'trace' || (event_id // 1000) AS trace_id, (event_id % 1000) * 2 AS pos0, direction = 'request' AS asks,
         CASE WHEN direction = 'request' THEN 'PassThruWriteMsgs' ELSE 'PassThruReadMsgs' END AS api, 'c' || (event_id % 500) AS call_id,
         printf('0000%04X', can_id) || payload AS payload_hex, event_type IN ('purchase', 'view') AS red FROM dm),
recs AS (
  SELECT trace_id, 0 AS sequence, 'session' AS kind, NULL AS call_id, NULL AS api, 0 AS msgs, false AS red, 0 AS ns FROM calls WHERE event_id % 1000 = 0
  UNION ALL SELECT trace_id, pos0 + 1, 'callBegin', call_id, api, CAST(asks AS INT), red, event_id * 1000 + 7 FROM calls WHERE k != 14
  UNION ALL SELECT trace_id, pos0 + 2, 'callEnd', call_id, CASE WHEN k = 13 THEN 'PassThruOther' ELSE api END, CAST(NOT asks AS INT), red, event_id * 1000 + 14 FROM calls WHERE k != 15)"""

_TM = """tm AS (
  SELECT trace_id, pos0 + CASE WHEN asks THEN 1 ELSE 2 END AS sequence, ts_us + 20000 AS ts_us, call_id,
         CASE WHEN k = 13 AND NOT asks THEN 'PassThruOther' ELSE api END AS api,
         CASE WHEN asks THEN 'applicationToProvider' WHEN k = 13 THEN 'other' ELSE 'providerToApplication' END AS direction,
         0 AS message_index, service_id, payload_hex, red AS payload_redacted, payload, asks
  FROM calls WHERE CASE WHEN asks THEN k != 14 ELSE k != 15 END)"""


def _definitions() -> str:
    return """pt AS (
  SELECT *, 'defs' || (p_partkey // 100) || '.dbc' AS path, 'P' || p_partkey AS message, p_name || ' "' || p_brand || '"' AS note,
         p_partkey % 4 = 0 AS is_extended, CASE WHEN p_partkey % 4 = 0 THEN 65536 + p_partkey ELSE p_partkey % 2048 END AS raw_id FROM part)"""


def _sets(name: str, cond: str) -> str:
    return f"coalesce((SELECT string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) FROM (SELECT DISTINCT can_id AS v FROM cl c WHERE c.module = m.module AND {cond})), '') AS {name}"


_TRANSCRIPT = """tl AS (
  SELECT *, event_id // 1000 AS file, CASE WHEN event_type = 'signup' THEN CASE WHEN k < 30 THEN 'BCM wake-up' WHEN k < 60 THEN 'Radio read'
         WHEN k < 80 THEN 'Instrument Cluster step' END END AS heading FROM dm),
hd AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY file ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS section FROM tl),
cl AS (SELECT *, CASE WHEN section LIKE 'BCM%' THEN 'BCM' WHEN section LIKE 'Radio%' THEN 'Radio' WHEN section LIKE 'Instr%' THEN 'Instrument Cluster' END AS module
       FROM hd WHERE event_type != 'signup')"""


def _pairing(request_id: str, extra: str) -> str:
    """Open requests carried from message to message: nd is the identifier negated, 1 for none; equal times go to the larger nd."""
    return _with(
        _EV, _DM,
        f"""ms AS (
  SELECT iface AS channel, {request_id} AS request_id, CASE WHEN event_type IN ('purchase', 'view') THEN 39 ELSE 34 END AS service, ts_us, event_id AS sequence,
         CASE WHEN direction = 'request' THEN 'request' ELSE 'response' END AS role, CASE WHEN event_type IN ('signup', 'click') THEN 61696 + k // 10 END AS did,
         CASE WHEN event_type = 'error' THEN CASE WHEN k < 50 THEN 120 ELSE 49 END END AS nrc,
         row_number() OVER (PARTITION BY iface, {request_id}, event_type IN ('purchase', 'view') ORDER BY event_id) AS rn FROM dm)""",
        """st AS (
  SELECT channel, request_id, service, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(t BIGINT, nd INT)[]) AS open, CAST(NULL AS STRUCT(t BIGINT, nd INT)) AS hit
  FROM (SELECT DISTINCT channel, request_id, service FROM ms)
  UNION ALL
  SELECT channel, request_id, service, rn,
         CASE WHEN role = 'request' THEN list_append(list_filter(open, lambda x: x.nd != own), {'t': ts_us, 'nd': own})
              WHEN h IS NOT NULL AND nrc IS DISTINCT FROM 120 THEN list_filter(open, lambda x: x.nd != h.nd) ELSE open END,
         CASE WHEN role != 'request' THEN h END
  FROM (SELECT m.*, CAST(coalesce(-did, 1) AS INT) AS own, s.open,
               coalesce(list_filter(s.open, lambda x: x.nd = coalesce(-m.did, 1))[1], list_sort(list_filter(s.open, lambda x: m.did IS NULL OR x.nd = 1))[-1]) AS h
        FROM st s JOIN ms m ON m.channel = s.channel AND m.request_id = s.request_id AND m.service = s.service AND m.rn = s.rn + 1))""",
        body=f"SELECT {extra}channel, request_id, ts_us, sequence, role, service, did, nrc, (ts_us - hit.t) / 1000.0 AS latency_ms FROM st JOIN ms USING (channel, request_id, service, rn)",
    ).replace("WITH ", "WITH RECURSIVE ", 1)


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["did_fifo"] = _with(
        _EV,
        """ms AS (
  SELECT iface AS channel, k // 10 AS d, event_id, ts_us, event_type = 'signup' AS asks, '22F1' || printf('%02X', k // 10) AS request_payload, printf('%04X', cents) AS data,
         row_number() OVER (PARTITION BY iface, k // 10 ORDER BY event_id) AS rn FROM ev WHERE event_type IN ('signup', 'click'))""",
        """st AS (
  SELECT channel, d, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(n BIGINT, t BIGINT)[]) AS waiting, CAST(NULL AS STRUCT(n BIGINT, t BIGINT)) AS hit
  FROM (SELECT DISTINCT channel, d FROM ms)
  UNION ALL
  SELECT channel, d, rn, CASE WHEN asks THEN list_append(waiting, {'n': rn, 't': ts_us}) WHEN h IS NULL THEN [] ELSE list_filter(waiting, lambda x: x.n > h.n) END, CASE WHEN NOT asks THEN h END
  FROM (SELECT m.*, s.waiting, list_filter(s.waiting, lambda x: m.ts_us - x.t BETWEEN 0 AND %d)[1] AS h
        FROM st s JOIN ms m ON m.channel = s.channel AND m.d = s.d AND m.rn = s.rn + 1))""" % DAY,
        body="""SELECT 'events' AS session_id, channel, '0xF1' || printf('%02X', d) AS did, hit.t / 1e6 AS request_ts, ts_us / 1e6 AS response_ts, (ts_us - hit.t) / 1000.0 AS latency_ms,
       request_payload, '62F1' || printf('%02X', d) || data AS response_payload, data, event_id AS completion_seq
FROM st JOIN ms USING (channel, d, rn) WHERE hit IS NOT NULL""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    q["live_pairs"] = _pairing("2016 + user_id % 3", "'events' AS session_id, ")
    q["live_monitor"] = _pairing("CASE WHEN user_id % 3 = 2 THEN 2018 ELSE 576 + user_id % 3 END", "")
    fr = (_EV, _FR)
    lf = (_EV, _LF)
    q["frames_bridge"] = _with(*fr, body="SELECT 'events' AS session_id, event_id AS sequence, ts_us, iface, arb_id, dlc, hx AS payload FROM fr")
    q["session_summary"] = _with(_EV, _VF, body="""SELECT iface AS session_id, CAST(min(ts_us) AS VARCHAR) AS metadata_started_utc, 'bridge' AS vehicle_model,
  '1' AS vehicle_generation, count(*) AS total_frames, iface AS logged_interface, iface AS bus_name, count(*) AS frames,
  count(DISTINCT arb_id) AS unique_arbitration_ids, 'captured' AS state FROM vf GROUP BY iface""")
    q["frame_count_check"] = _with(_EV, body="SELECT iface AS session_id, count(*) + 1 AS total_frames, count(*) AS parsed FROM ev WHERE iface = 'can1' GROUP BY iface")
    q["id_activity"] = _with(*lf, _LBY, _BYTE_METRICS, _ID_METRICS, body="SELECT * FROM im")
    q["byte_activity"] = _with(*lf, _LBY, _BYTE_METRICS, body="""SELECT 'events' AS session_id, *,
  1e2 * change_count / greatest(observation_count - 1, 1) + least(distinct_values - 1, 32) AS activity_score FROM bm""")
    q["top_ids"] = _with(*lf, _LBY, _BYTE_METRICS, _ID_METRICS, body="SELECT * FROM im ORDER BY round(activity_score, 6) DESC, frame_count DESC, iface, arb_id LIMIT 25")
    q["id_counts"] = _with(*fr, body="SELECT iface, arb_id, count(*) AS frames FROM fr GROUP BY ALL")
    q["dlc_histogram"] = _with(*fr, body="SELECT iface, arb_id, dlc, count(*) AS frames FROM fr GROUP BY ALL")
    q["dominant_dlc"] = _with(*fr, _DOMINANT, body="SELECT * FROM dom")
    q["period_stats"] = _with(*fr, _BUS, body="""SELECT 'bus' AS iface, typed_id AS arb_id, median(m) / 1000.0 AS median_period_ms FROM (
  SELECT iface, typed_id, median(gap) AS m FROM (
    SELECT iface, typed_id, ts_us - lag(ts_us) OVER (PARTITION BY iface, typed_id ORDER BY ts_us) AS gap FROM bus) WHERE gap IS NOT NULL GROUP BY ALL) GROUP BY typed_id""")
    q["change_rate"] = _with(*lf, _BUS, """bb AS (
  SELECT typed_id, iface, ts_us, event_id, {'i': CAST(i AS INT), 'v': bl[i + 1]} AS s FROM (SELECT *, unnest(range(len(bl))) AS i FROM bus))""", body=f"""
SELECT 'bus' AS iface, typed_id AS arb_id, i AS byte_index, count(*) AS observations, min(v) AS minimum_value, max(v) AS maximum_value,
       CASE WHEN count(*) > 1 THEN sum(ch) / CAST(count(*) - 1 AS DOUBLE) ELSE 0 END AS change_rate
FROM (SELECT *, {_CHANGED.format(v='v')} AS ch FROM (SELECT typed_id, iface, ts_us, event_id, s.i AS i, s.v AS v FROM bb) WHERE v IS NOT NULL
      WINDOW w AS (PARTITION BY typed_id, i ORDER BY iface, ts_us, event_id)) GROUP BY typed_id, i""")
    q["payload_transitions"] = _with(*fr, body="""SELECT iface, arb_id, event_id AS sequence, coalesce(lag(hx) OVER w != hx, false) AS changed FROM fr
WINDOW w AS (PARTITION BY iface, arb_id ORDER BY ts_us, event_id)""")
    q["explode_bytes"] = _with(*lf, _LBY, body="SELECT event_id AS sequence, byte_index, value FROM bt")
    q["bit_probability"] = _with(*lf, _LBITS, body="""SELECT iface, typed_id AS arb_id, s.byte_index AS byte_index, s.bit_index AS bit_index, CAST(sum(s.bit) AS BIGINT) AS ones, count(s.bit) AS frames
FROM bits WHERE s.bit IS NOT NULL GROUP BY ALL""")
    q["word_ranges"] = _with(*lf, _LSERIES.replace("SRC", "fr"), body="""SELECT iface, typed_id AS arb_id, s.kind AS kind, s."offset" AS "offset", count(*) AS n, min(s.x) AS lo, max(s.x) AS hi,
  CAST(sum(s.x) AS BIGINT) AS total FROM series WHERE s.x IS NOT NULL GROUP BY ALL""")

    signed = "CASE WHEN cents >= 32768 THEN cents - 65536 ELSE cents END"
    odd = "((b1 & 31) << 8) | b2"
    row = lambda i, s, v, c="true": f"SELECT event_id AS sequence, typed_id AS arb_id, '{s}' AS signal, round(CAST({v} AS DOUBLE), 6) AS value FROM fr WHERE typed_id = {i} AND {c}"
    q["decode_registry"] = _with(*fr, body="\nUNION ALL ".join([
        row(257, "kind", "code"), row(257, "cents", "cents * CAST(0.01 AS DOUBLE)"), row(258, "cents_signed", f"({signed}) * CAST(0.01 AS DOUBLE) - 1"),
        row(259, "low_intel", "((b2 & 15) * 256 + b1) * 0.5 + 2"), row(259, "k_motorola", "b3", "b3 IS NOT NULL"), row(260, "k_intel", "coalesce(b3, 0)"),
        row(260, "wide_signed_intel", "CASE WHEN b2 * 256 + b1 >= 32768 THEN b2 * 256 + b1 - 65536 ELSE b2 * 256 + b1 END"),
        row(261, "odd", f"(CASE WHEN ({odd}) >= 4096 THEN ({odd}) - 8192 ELSE ({odd}) END) * CAST(0.15 AS DOUBLE)"),
    ]))
    q["decode_hv_frames"] = _hv()
    q["decode_bicm_frames"] = _bicm()
    q["decode_dc_link"] = _with(_EV, _VF, body="SELECT event_id AS sequence, arb_id, 'dcLinkVoltage' AS signal, round(CAST((c2 * 256 + c3) * 0.0125 AS DOUBLE), 6) AS value FROM vf WHERE arb_id = 552")
    q["decode_contactor"] = _with(_EV, _VF, body="""SELECT event_id AS seq, iface AS channel, c1 AS raw_state, true AS known,
  CASE c1 WHEN 104 THEN 'hvOff' WHEN 106 THEN 'firstMainContactorEngaged' WHEN 111 THEN 'prechargeActive' ELSE 'hvBusEstablished' END AS phase,
  c1 & 1 > 0 AS main_contactor_bit0, c1 & 2 > 0 AS main_contactor_bit1, c1 & 4 > 0 AS precharge_bit2 FROM vf WHERE arb_id = 1516""")
    one = lambda s, v, c: f"SELECT event_id AS sequence, arb_id, '{s}' AS signal, round(CAST({v} AS DOUBLE), 6) AS value FROM vf WHERE {c}"
    q["decode_startup_signals"] = _with(_EV, _VF, body="\nUNION ALL ".join([
        one("brakePressed", "CASE WHEN c0 & 2 > 0 THEN 1 ELSE 0 END", "arb_id = 241"), one("brakePosition", "c1", "arb_id = 241"), one("systemPowerMode", "c0 & 3", "arb_id = 497"),
        one("hvBatteryCurrent", _AMPS, "arb_id = 711"), one("hvBatteryVoltage", _VOLTS, "arb_id = 711"),
    ]))
    cat = lambda i, s, v, t="NULL", c="true": f"SELECT event_id AS sequence, typed_id AS arb_id, '{s}' AS signal, round(CAST({v} AS DOUBLE), 6) AS value, {t} AS text FROM fr WHERE typed_id = {i} AND {c}"
    q["decode_catalog"] = _with(*fr, body="\nUNION ALL ".join([
        cat(257, "flag", "(b2 >> 3) & 1", "CASE WHEN (b2 >> 3) & 1 = 1 THEN 'on' ELSE 'off' END"), cat(258, "kind", "b0", "'click'"), cat(259, "raw8", "b1"),
        cat(260, "raw16", "cents"), cat(261, "signed16", f"({signed}) * 0.0625"),
        cat(257, "field", "(b2 & 12) >> 2", "CASE (b2 & 12) >> 2 WHEN 0 THEN 'none' WHEN 3 THEN 'both' END"), cat(258, "dbc", "cents * 0.5 + 1"),
        cat(259, "whole", "NULL", "CASE WHEN hx = '03000A' THEN 'ten' END"),
    ]))
    q["cells_snapshot"] = _with(_EV, _VF, _BF, f"""lat AS (
  SELECT slot, arg_max([{', '.join(f'((c{2 * i} & 15) * 256 + c{2 * i + 1}) * CAST(0.00125 AS DOUBLE)' for i in range(3))}], struct_pack(t := ts_us, e := event_id)) AS v
  FROM (SELECT *, CASE WHEN bid - 1120 >= 16 THEN (bid - 1136) * 2 + 1 ELSE (bid - 1120) * 2 END AS slot FROM bf WHERE bid < 1280) GROUP BY slot),
al AS (SELECT list_reverse(flatten(list(v ORDER BY slot))) AS l FROM lat)""", body="""SELECT 'all' AS session_id, CAST(len(l) AS INT) AS observed_values, CAST(i AS INT) AS cell, l[i + 1] AS volts FROM al, range(0, 96) t(i) WHERE len(l) = 96
UNION ALL SELECT 'all', CAST(len(l) AS INT), NULL, NULL FROM al WHERE len(l) != 96""")

    q["window_correlation"] = _correlation(str(3 * HOUR), "s0", "s0 DESC, iface DESC, arb_id DESC, byte_index DESC")
    q["voice_correlation"] = _correlation(str(3 * HOUR), "round(s0, 6)", "round(s0, 6) DESC, iface, arb_id, byte_index")
    q["annotation_windows"] = _with(*fr, _ANN.format(end=3 * HOUR), body=f"""SELECT iface AS session_id, annotation_idx, ts_us >= start_us AS action, count(*) AS frames, bit_xor(event_id) AS checksum
FROM fr JOIN ann USING (iface) WHERE ts_us >= start_us - {6 * HOUR} AND ts_us < end_us GROUP BY ALL""")
    h6 = 6 * HOUR
    q["bit_event_candidates"] = _with(*lf, _LBITS, _ANN.format(end=3 * HOUR), f"""pb AS (
  SELECT annotation_idx, iface, typed_id, dlc, s.byte_index AS byte_index, s.bit_index AS bit_index,
         CASE WHEN ts_us < start_us THEN 'b' WHEN ts_us < end_us THEN 'e' ELSE 'a' END AS ph, s.bit AS bit
  FROM bits JOIN ann USING (iface) WHERE ts_us >= start_us - {h6} AND ts_us < end_us + {h6} AND s.bit IS NOT NULL),
pp AS (SELECT annotation_idx, iface, typed_id, dlc, byte_index, bit_index, count(*) FILTER (ph = 'b') AS nb, count(*) FILTER (ph = 'e') AS ne, count(*) FILTER (ph = 'a') AS na,
         sum(bit) FILTER (ph = 'b') / CAST(count(*) FILTER (ph = 'b') AS DOUBLE) AS p_base, sum(bit) FILTER (ph = 'e') / CAST(count(*) FILTER (ph = 'e') AS DOUBLE) AS p_event,
         sum(bit) FILTER (ph = 'a') / CAST(count(*) FILTER (ph = 'a') AS DOUBLE) AS p_after FROM pb GROUP BY ALL)""", body="""
SELECT iface AS session_id, annotation_idx AS discovery_id, 'bus' AS channel, typed_id AS id, false AS extended, dlc AS length, byte_index, bit_index, p_base, p_event, p_after,
       abs(p_event - (p_base + p_after) / 2) - abs(p_base - p_after) / 2 AS score
FROM pp WHERE nb >= 3 AND ne >= 3 AND na >= 3 AND abs(p_event - (p_base + p_after) / 2) >= CAST(0.45 AS DOUBLE) AND abs(p_base - p_after) <= CAST(0.30 AS DOUBLE)""")
    sp = "sp AS (SELECT iface AS source, event_id, ts_us, cents AS speed FROM ev WHERE event_type = 'view')"
    near = f"""nr AS (
  SELECT * FROM (
    SELECT f.iface AS source, f.event_id, f.ts_us, s.speed, abs(s.ts_us - f.ts_us) AS delta,
           row_number() OVER (PARTITION BY f.event_id ORDER BY abs(s.ts_us - f.ts_us), s.ts_us DESC, CASE WHEN s.ts_us >= f.ts_us THEN s.event_id ELSE -s.event_id END) AS r
    FROM fr f JOIN sp s ON s.source = f.iface AND s.ts_us BETWEEN f.ts_us - {HOUR} AND f.ts_us + {HOUR}) WHERE r = 1)"""
    q["nearest_within"] = _with(*fr, sp, near, body="SELECT source, event_id AS sequence, ts_us, speed, delta FROM nr")
    q["signal_speed_correlation"] = _with(*lf, _BUS, sp, near, _LSERIES.replace("SRC", "bus"), """cr AS (
  SELECT 'bus' AS bus, typed_id AS can_id, s.kind AS kind, s."offset" AS "offset", count(*) AS overlap,
         round(coalesce(covar_pop(CAST(s.x AS DOUBLE), CAST(speed AS DOUBLE)) / nullif(stddev_pop(CAST(s.x AS DOUBLE)) * stddev_pop(CAST(speed AS DOUBLE)), 0), 0), 6) AS r
  FROM series JOIN nr USING (event_id) WHERE s.x IS NOT NULL GROUP BY ALL HAVING count(*) >= 20)""", body="""
SELECT bus, can_id, kind, "offset", r, abs(r) AS abs_r, overlap, CASE WHEN abs(r) >= 0.95 THEN 'strongCandidate' WHEN abs(r) >= 0.8 THEN 'candidate' WHEN abs(r) >= 0.6 THEN 'weakCandidate' ELSE 'background' END AS confidence
FROM cr ORDER BY abs_r DESC, overlap DESC, bus, can_id, CASE WHEN kind = 'u8' THEN 0 ELSE 1 END, "offset", CASE WHEN kind = 'u16be' THEN 1 ELSE 0 END LIMIT 50""")
    q["live_validation_steps"] = _with(_EV, """mk AS (SELECT iface, ts_us, event_id, CASE WHEN k >= 20 THEN CAST((k // 10) * 10 AS DOUBLE) END AS target FROM ev WHERE event_type = 'purchase')""", body="""
SELECT iface AS session_id, target AS target_mph, count(*) AS samples, min(cents) AS raw_min, max(cents) AS raw_max, sum(cents) / CAST(count(*) AS DOUBLE) AS raw_mean
FROM (SELECT e.iface, e.cents, m.target FROM ev e ASOF JOIN mk m ON e.iface = m.iface AND e.ts_us >= m.ts_us WHERE e.event_type = 'click') WHERE target IS NOT NULL GROUP BY iface, target""")

    q["state_runs"] = _with(_EV, _RUNS.format(part="0"), body="SELECT channel, seq, ts_us, raw_state FROM runs")
    daily = _RUNS.format(part=_DAY)
    q["sequence_class"] = _with(_EV, daily, _FACTS, body=f"SELECT channel, day, runs, {_CLASS} AS classification FROM facts")
    q["cadence_stats"] = _with(_EV, body="""SELECT channel, median(gap) / 1000.0 AS median_ms, sum(gap) / CAST(count(*) AS DOUBLE) / 1000.0 AS mean_ms, min(gap) / 1000.0 AS min_ms, max(gap) / 1000.0 AS max_ms FROM (
  SELECT 'u' || user_id AS channel, ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us) AS gap FROM ev) WHERE gap IS NOT NULL GROUP BY channel""")
    q["state_counts"] = _with(_EV, body="SELECT 'u' || user_id AS channel, state AS raw_state, count(*) AS samples FROM ev GROUP BY ALL")
    q["marker_window"] = _with(_EV, """mk AS (SELECT iface, ts_us, k < 50 AS starts FROM ev WHERE event_type = 'error'),
lo AS (SELECT iface, min(ts_us) FILTER (starts) AS lo, count(*) FILTER (NOT starts) AS ends FROM mk GROUP BY iface),
bd AS (SELECT iface, lo, ends, (SELECT min(ts_us) FROM mk WHERE NOT starts AND mk.iface = lo.iface AND ts_us >= lo.lo) AS hi FROM lo)""", body="""
SELECT iface AS session_id, 'u' || user_id AS channel, count(*) AS samples FROM ev LEFT JOIN bd USING (iface)
WHERE lo IS NULL OR ends = 0 OR (ts_us >= lo AND (hi IS NULL OR ts_us <= hi)) GROUP BY ALL""")
    q["channel_coverage"] = _with(_EV, body="""SELECT 'events' AS session_id, iface AS channel, (min(ts_us) - (SELECT min(ts_us) FROM ev)) / 1e6 AS first_seconds,
  (max(ts_us) - (SELECT min(ts_us) FROM ev)) / 1e6 AS last_seconds, count(*) AS frames FROM ev GROUP BY iface""")
    step = lambda name, at, amps="NULL", volts="NULL", raw="NULL", mode="NULL": f"SELECT '{name}' AS event, round(({at} - t0) / 1e6, 6) AS seconds, round(CAST({amps} AS DOUBLE), 6) AS current_a, round(CAST({volts} AS DOUBLE), 6) AS voltage_v, {raw} AS raw_position, {mode} AS system_power_mode FROM st2 WHERE {at} IS NOT NULL"
    at_hv = lambda x: f"(SELECT {x} FROM vf WHERE arb_id = 711 AND ts_us = hv)"
    q["first_transitions"] = _with(_EV, _VF, _START, body="\nUNION ALL ".join([
        step("brakePedalMovementBegins", "motion", raw="motion_raw"), step("brakePedalPressed", "pressed"), step("startRequest", "crank", mode="3"),
        step("hvCurrentTransient", "hv", amps=at_hv(_AMPS), volts=at_hv(_VOLTS)), step("systemRun", "run", mode="2"),
    ]))
    q["startup_intervals"] = _with(_EV, _VF, _START, body="""SELECT 'all' AS session_id, (crank - motion) / 1000.0 AS movement_to_start_ms, (hv - crank) / 1000.0 AS start_to_transient_ms,
  (run - crank) / 1000.0 AS start_to_run_ms, (run - hv) / 1000.0 AS transient_to_run_ms, coalesce(hs >= crank, false) AS direct_hv_present_at_start FROM st2""")
    q["precharge_report"] = _with(_EV, daily, _FACTS, _assessed("facts"), body=f"""SELECT channel, day,
  CASE WHEN pc IS NOT NULL AND voltage_result = 'failedToRise' THEN 'prechargeVoltageFailedToRise' WHEN pc IS NOT NULL AND voltage_result = 'roseButDidNotConverge' THEN 'prechargeVoltageDidNotConverge'
       WHEN {_CLASS} = 'successfulStartup' THEN 'successfulStartup' WHEN l[1] = 104 AND fm IS NULL THEN 'noMainContactorEngagement' WHEN l[1] = 104 AND pc IS NULL THEN 'stalledAfterFirstMainContactor'
       WHEN l[1] = 104 AND pc IS NOT NULL AND es IS NULL THEN 'stalledInPrecharge' ELSE 'unexpectedOrIncompleteSequence' END AS result,
  voltage_result, runs, fm AS first_main_us, pc AS precharge_us, es AS established_us, (pc - fm) / 1000.0 AS first_main_to_precharge_ms, (es - pc) / 1000.0 AS precharge_to_established_ms,
  start_dc, max_dc, max_pack, best_ratio FROM facts JOIN vv USING (channel, day)""")
    q["precharge_assessment"] = _with(_EV, f"""ww AS (SELECT 'u' || user_id AS channel, {_DAY} AS day, min(CASE WHEN state = 111 THEN ts_us END) AS pc, max(CASE WHEN state = 107 THEN ts_us END) AS es FROM ev GROUP BY ALL)""",
        _assessed("ww"), body="SELECT channel, day, voltage_result, voltage_samples, start_dc, max_dc, max_pack, best_ratio FROM vv")

    q["isotp_reassembly"] = _isotp(True)
    q["isotp_unchecked"] = _isotp(False)
    dm = (_EV, _DM)
    q["diag_events"] = _with(*dm, body="""SELECT event_id AS pos, ts_us, iface AS channel, can_id, payload, direction, service, service_id,
  CASE WHEN event_type != 'error' THEN '0x' || substr(payload, 1, 2) END AS wire_service_id, CASE WHEN event_type = 'error' THEN '0x' || substr(payload, 5, 2) END AS nrc_code, nrc_name,
  CASE WHEN event_type IN ('signup', 'click') THEN '0x' || substr(payload, 3, 4) END AS did, CASE WHEN event_type = 'click' THEN substr(payload, 7) END AS did_data,
  CASE WHEN service_id = '0x27' THEN '0x' || substr(payload, 3, 2) END AS security_access_type,
  CASE WHEN service_id = '0x27' THEN CASE WHEN k % 2 = 1 THEN 'requestSeed' ELSE 'sendKey' END END AS security_operation,
  CASE WHEN service_id = '0x27' THEN substr(payload, 5) END AS security_data FROM dm""")
    q["diag_summary"] = _with(*dm, _REFS, _TX, _TRAFFIC, body="""SELECT 'events' AS section, 'all' AS name, count(*) AS value FROM dm
UNION ALL SELECT 'services', service, count(*) FROM dm GROUP BY service UNION ALL SELECT 'requests', service, count(*) FROM dm WHERE direction = 'request' GROUP BY service
UNION ALL SELECT 'negative_responses', nrc_name, count(*) FROM dm WHERE event_type = 'error' GROUP BY nrc_name
UNION ALL SELECT 'programming_services', service, count(*) FROM dm WHERE service = 'SecurityAccess' GROUP BY service
UNION ALL SELECT 'modules_observed', module, count(*) FROM traffic GROUP BY module UNION ALL SELECT 'traffic_by_role', role, count(*) FROM traffic GROUP BY role
UNION ALL SELECT 'transactions', 'all', count(*) FROM tx UNION ALL SELECT 'answered_transactions', 'all', count(*) FROM tx WHERE NOT unanswered
UNION ALL SELECT 'unanswered_transactions', 'all', count(*) FROM tx WHERE unanswered""")
    q["address_annotation"] = _with(*dm, body="""SELECT can_id, CASE WHEN can_id != 2026 THEN 'M' || (user_id % 3) END AS likely_module, CASE WHEN can_id != 2026 THEN CASE WHEN can_id < 2020 THEN 'request' ELSE 'normalResponse' END END AS address_role,
  CASE WHEN can_id != 2026 THEN 'legacyReference' END AS address_evidence, CASE WHEN can_id = 2026 THEN 2 ELSE 1 END AS matches, count(*) AS events FROM dm GROUP BY ALL""")
    q["legacy_events"] = _with(*dm, body="""SELECT ts_us, iface AS channel, can_id, payload, direction, service, 'legacyUnframedReference' AS transport FROM dm d
WHERE NOT EXISTS (SELECT 1 FROM dm i WHERE i.ts_us = d.ts_us AND i.iface = d.iface AND i.can_id = d.can_id AND substr(i.payload, 5, 2) < '32')""")
    q["merge_events"] = _with(*dm, body="""SELECT CASE WHEN direction = 'negativeResponse' THEN 'legacyUnframedReference' ELSE 'isoTp' END AS transport, direction, service, count(*) AS events,
  bit_xor(ts_us) AS checksum FROM dm GROUP BY ALL""")
    q["endpoint_traffic"] = _with(*dm, _REFS, _TRAFFIC, body="SELECT * FROM traffic")
    q["pair_transactions"] = _with(*dm, _TX, body="SELECT * FROM tx")
    q["redact_hash"] = _with(*dm, body="""SELECT event_id AS pos, service, CASE WHEN service = 'SecurityAccess' THEN '<redacted>' ELSE payload END AS payload,
  CASE WHEN service = 'SecurityAccess' THEN sha256(unhex(payload)) END AS payload_sha256, CASE WHEN service = 'SecurityAccess' THEN CAST(length(payload) // 2 AS INT) END AS payload_length,
  service = 'SecurityAccess' AS payload_redacted, CASE WHEN service = 'SecurityAccess' THEN '<redacted>' END AS security_data FROM dm""")
    q["asof_definition"] = _with(_EV, """df AS (SELECT ts_us, event_id, iface, k // 10 AS p, printf('0x%04X', cents) AS did FROM ev WHERE event_type = 'signup'),
sm AS (SELECT e.*, d.did FROM (SELECT *, k // 10 AS p FROM ev WHERE event_type NOT IN ('signup', 'purchase')) e ASOF LEFT JOIN df d ON e.iface = d.iface AND e.p = d.p AND e.ts_us >= d.ts_us)""", body="""
SELECT 'dynamicDefinition' AS kind, ts_us, iface AS channel, p AS packet_id, did AS dids, NULL AS data, NULL AS single_did, NULL AS single_did_data, NULL AS rate, NULL AS state FROM df
UNION ALL SELECT 'dynamicPacketControl', ts_us, iface, k // 10, '', NULL, NULL, NULL, k % 3, CASE k % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'single' ELSE 'periodic' END FROM ev WHERE event_type = 'purchase'
UNION ALL SELECT 'dynamicPacketSample', ts_us, iface, p, coalesce(did, ''), printf('%04X', cents), did, CASE WHEN did IS NOT NULL THEN printf('%04X', cents) END, NULL, NULL FROM sm""")

    tr = (*dm, _TR)
    q["trace_validation"] = _with(*tr, """sq AS (SELECT *, lag(sequence) OVER (PARTITION BY trace_id ORDER BY sequence) AS p FROM recs),
cq AS (SELECT *, lag(kind) OVER w AS pk, lag(api) OVER w AS pa FROM recs WHERE kind != 'session' WINDOW w AS (PARTITION BY trace_id, call_id ORDER BY sequence))""", body="""
SELECT trace_id, sequence + 1 AS line, 'nonContiguousSequence' AS rule, CAST(sequence AS VARCHAR) AS detail FROM sq WHERE sequence != coalesce(p + 1, 0)
UNION ALL SELECT trace_id, sequence + 1, 'firstRecordNotSession', kind FROM sq WHERE p IS NULL AND kind != 'session'
UNION ALL SELECT trace_id, sequence + 1, 'duplicateCallBegin', call_id FROM cq WHERE kind = 'callBegin' AND pk = 'callBegin'
UNION ALL SELECT trace_id, sequence + 1, 'orphanCallEnd', call_id FROM cq WHERE kind = 'callEnd' AND pk IS DISTINCT FROM 'callBegin'
UNION ALL SELECT trace_id, sequence + 1, 'apiMismatch', api FROM cq WHERE kind = 'callEnd' AND pk = 'callBegin' AND api != pa""")
    q["trace_summary"] = _with(*tr, body="""SELECT trace_id, 'totals' AS section, t.name AS name, t.value AS value FROM (
  SELECT trace_id, unnest([{'name': 'records', 'value': count(*)}, {'name': 'calls_started', 'value': count(*) FILTER (kind = 'callBegin')}, {'name': 'calls_completed', 'value': count(*) FILTER (kind = 'callEnd')},
    {'name': 'messages', 'value': CAST(sum(msgs) AS BIGINT)}, {'name': 'redacted_messages', 'value': CAST(sum(CASE WHEN red THEN msgs ELSE 0 END) AS BIGINT)}]) AS t FROM recs GROUP BY trace_id)
UNION ALL SELECT trace_id, 'api', api, count(*) FROM recs WHERE kind = 'callBegin' GROUP BY trace_id, api""")
    q["trace_messages"] = _with(*tr, _TM, body="SELECT trace_id, sequence, ts_us, call_id, api, direction, message_index, service_id, payload_hex, payload_redacted FROM tm")
    q["pair_calls"] = _with(*tr, """oc AS (SELECT *, sum(CASE WHEN kind = 'callBegin' THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id, call_id ORDER BY sequence) AS occurrence FROM recs WHERE kind != 'session')""", body="""
SELECT b.trace_id, b.call_id, CAST(b.occurrence AS BIGINT) AS occurrence, b.api, b.sequence AS begin_sequence, e.sequence AS end_sequence, CASE WHEN e.sequence IS NOT NULL THEN 0 END AS return_code, e.ns - b.ns AS duration_ns
FROM (SELECT * FROM oc WHERE kind = 'callBegin') b LEFT JOIN (SELECT * FROM oc WHERE kind = 'callEnd') e USING (trace_id, call_id, occurrence)""")
    q["payload_candidates"] = _with(*tr, _TM, body="""SELECT trace_id, sequence, payload_hex AS candidate FROM tm WHERE NOT payload_redacted
UNION ALL SELECT trace_id, sequence, substr(payload_hex, 9) FROM tm WHERE NOT payload_redacted AND length(payload_hex) > 8""")
    q["band_match"] = _with(*tr, _TM, """rk AS (
  SELECT m.trace_id, m.sequence, m.direction, m.service_id, m.payload_redacted, abs(d.ts_us - m.ts_us) AS delta, d.ts_us AS bus_us, d.service AS bus_service,
         (NOT m.payload_redacted) AND d.service != 'SecurityAccess' AND suffix(m.payload_hex, d.payload) AS exact, d.service_id = m.service_id AS served, d.service = 'SecurityAccess' AS bus_red, d.event_id
  FROM tm m JOIN dm d ON m.trace_id = 'trace' || (d.event_id // 1000) AND d.ts_us BETWEEN m.ts_us - 600000000 AND m.ts_us + 600000000 AND (d.direction = 'request') = m.asks WHERE m.direction != 'other'),
bst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, sequence ORDER BY exact DESC, served DESC, delta, bus_us, event_id) AS r FROM rk) WHERE r = 1)""", body="""
SELECT m.trace_id, m.sequence, m.direction, m.service_id, CASE WHEN b.delta IS NULL THEN 'noBusCandidateInWindow' WHEN exact THEN 'exactPayloadAndTimeMatch' WHEN served THEN 'serviceAndTimeCandidate' ELSE 'timeOnlyCandidate' END AS status,
  delta / 1000.0 AS delta_ms, NOT m.payload_redacted AND NOT bus_red AS payload_compared, bus_us / 1e6 AS bus_ts, bus_service
FROM tm m LEFT JOIN bst b ON b.trace_id = m.trace_id AND b.sequence = m.sequence WHERE m.direction != 'other'""")
    q["marker_nearest"] = _with(*dm, """mk AS (SELECT event_id AS marker_id, iface, ts_us AS s, ts_us + k * 1000000 AS e, 'purchase ' || k AS label FROM ev WHERE event_type = 'purchase')""", body=f"""
SELECT channel AS session_id, marker_id, label, rank, delta / 1000.0 AS delta_ms, pos, channel, service FROM (
  SELECT *, row_number() OVER (PARTITION BY marker_id ORDER BY delta, ts_us, pos) AS rank FROM (
    SELECT marker_id, label, d.event_id AS pos, d.ts_us, d.iface AS channel, d.service, CASE WHEN d.ts_us BETWEEN s AND e THEN 0 ELSE least(abs(d.ts_us - s), abs(d.ts_us - e)) END AS delta
    FROM mk JOIN dm d ON d.iface = mk.iface AND d.ts_us BETWEEN s - {3 * HOUR} AND e + {3 * HOUR})) WHERE rank <= 12""")
    q["union_markers"] = _with(_EV, body="""SELECT ts_us AS start_us, 'purchase ' || k AS label, 'operator' AS source, NULL AS annotation_idx FROM ev WHERE event_type = 'purchase'
UNION ALL SELECT ts_us, NULL, 'voice', event_id FROM ev WHERE event_type = 'error'""")
    q["bundle_summary"] = _with(*dm, _TX, _TR, _TM, body="""SELECT 'operator_markers' AS layer, count(*) AS rows FROM ev WHERE event_type = 'purchase'
UNION ALL SELECT 'diagnostic_events', count(*) FROM dm UNION ALL SELECT 'transactions', count(*) FROM tx UNION ALL SELECT 'trace_messages', count(*) FROM tm""")

    scores = f"""cl AS (SELECT 'Cell_' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') AS cell, iface, ts_us, event_id, CAST(3.6 AS DOUBLE) + cents / CAST(1e6 AS DOUBLE) AS v FROM ev WHERE event_type = 'view'),
sl AS (SELECT 'Slot_' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') AS slot, iface, ts_us, event_id, CAST(3.6 AS DOUBLE) + cents / CAST(1e6 AS DOUBLE) AS v FROM ev WHERE event_type = 'click'),
pr AS (SELECT * FROM (SELECT c.iface, cell, slot, c.ts_us, c.event_id, c.v AS cv, s.v AS sv, row_number() OVER (PARTITION BY slot, c.event_id ORDER BY abs(s.ts_us - c.ts_us), s.ts_us DESC, s.event_id DESC) AS r
       FROM cl c JOIN sl s ON s.iface = c.iface AND s.ts_us BETWEEN c.ts_us - {HOUR // 2} AND c.ts_us + {HOUR // 2}) WHERE r = 1),
dl AS (SELECT *, cv - lag(cv) OVER w AS dc, sv - lag(sv) OVER w AS ds FROM pr WINDOW w AS (PARTITION BY iface, cell, slot ORDER BY ts_us, event_id)),
ag AS (SELECT iface, cell, slot, count(*) AS overlap, sqrt(sum((cv - sv) * (cv - sv)) / count(*)) AS rmse, CASE WHEN count(dc) >= 2 THEN coalesce(covar_pop(dc, ds) / nullif(stddev_pop(dc) * stddev_pop(ds), 0), 0) ELSE 0 END AS r FROM dl GROUP BY ALL),
sc AS (SELECT iface AS session_id, cell, slot, CASE WHEN coalesce(overlap, 0) < 2 THEN 0.0 ELSE round(CAST(0.65 AS DOUBLE) * greatest(r, 0) + CAST(0.25 AS DOUBLE) * exp(-rmse / CAST(0.005 AS DOUBLE)) + CAST(0.1 AS DOUBLE) * least(1.0, overlap / CAST(8 AS DOUBLE)), 6) END AS score,
         CASE WHEN coalesce(overlap, 0) < 2 THEN 0.0 ELSE round(r, 6) END AS delta_correlation, CASE WHEN coalesce(overlap, 0) < 2 THEN 999.0 ELSE round(rmse, 6) END AS rmse_v, coalesce(overlap, 0) AS overlap
       FROM (SELECT DISTINCT iface, cell FROM cl) JOIN (SELECT DISTINCT iface, slot FROM sl) USING (iface) LEFT JOIN ag USING (iface, cell, slot))"""
    q["series_pair_score"] = _with(_EV, scores, body="SELECT * FROM sc")
    q["top_alternatives"] = _with(_EV, scores, body="SELECT session_id, cell, rank, slot, score FROM (SELECT *, row_number() OVER (PARTITION BY session_id, cell ORDER BY score DESC, slot) AS rank FROM sc) WHERE rank <= 3")
    q["greedy_assign"] = "WITH RECURSIVE " + ",\n".join([_EV, scores, """rn AS (SELECT *, session_id || cell AS c, session_id || slot AS s, row_number() OVER (ORDER BY score DESC, cell, slot, session_id) AS n FROM sc),
go AS (SELECT 0 AS n, CAST([] AS VARCHAR[]) AS uc, CAST([] AS VARCHAR[]) AS us, false AS hit
  UNION ALL SELECT r.n, CASE WHEN ok THEN list_append(uc, r.c) ELSE uc END, CASE WHEN ok THEN list_append(us, r.s) ELSE us END, ok
  FROM (SELECT g.uc, g.us, r0.*, NOT list_contains(g.uc, r0.c) AND NOT list_contains(g.us, r0.s) AS ok FROM go g JOIN rn r0 ON r0.n = g.n + 1) r)"""]) + """
SELECT session_id, cell, slot, score, rmse_v, delta_correlation, overlap, CASE WHEN overlap < 4 THEN 'insufficientOverlap' WHEN score >= 0.9 AND rmse_v <= 0.003 THEN 'strongCandidate' WHEN score >= 0.75 THEN 'candidate' ELSE 'weakCandidate' END AS confidence,
  'candidateOnly' AS mapping_status FROM rn JOIN go USING (n) WHERE hit"""
    q["cross_session_mapping"] = _with(_EV, f"""ob AS (SELECT {_DAY} AS session, 'Cell_' || (user_id % 96) AS cell, min(CASE WHEN user_id % 3 = 0 OR k < 97 THEN 'A' ELSE 'B' END) AS slot, CAST(0.9 AS DOUBLE) + max(k) / CAST(1000 AS DOUBLE) AS score,
  min(k) / CAST(20000 AS DOUBLE) AS rmse, max(k) >= 5 AS strong FROM ev GROUP BY ALL)""", body="""
SELECT cell, CASE WHEN min(slot) = max(slot) THEN min(slot) END AS slot, count(*) AS sessions, round(avg(score), 6) AS mean_score, round(max(rmse), 6) AS max_rmse_v,
  CASE WHEN count(*) >= 3 AND min(slot) = max(slot) AND avg(score) >= 0.9 AND max(rmse) <= 0.003 AND bool_and(strong) THEN 'repeatableCrossSessionCandidate' WHEN min(slot) != max(slot) THEN 'inconsistentAcrossSessions' ELSE 'needsMoreEvidence' END AS status
FROM ob GROUP BY cell""")
    q["corroboration_gate"] = _with(_EV, body="""SELECT 'signal' || user_id AS signal, count(DISTINCT event_type) AS source_families, count(DISTINCT CASE WHEN user_id % 2 = 0 OR k < 90 THEN 12 ELSE 13 END) AS variants,
  CASE WHEN count(DISTINCT event_type) >= 3 AND count(DISTINCT CASE WHEN user_id % 2 = 0 OR k < 90 THEN 12 ELSE 13 END) = 1 THEN 'communityCorroborated' ELSE 'candidate' END AS status FROM ev GROUP BY user_id""")
    bn = """bn AS (SELECT *, 576 + user_id % 40 AS can_id, CASE WHEN k % 9 BETWEEN 1 AND 7 AND k % 9 <= 6 THEN printf('0x%02X', k) ELSE 'unsupportedTransport' END AS svc FROM ev WHERE event_type != 'purchase' AND user_id % 40 NOT IN (4, 5))"""
    q["unknown_modules"] = _with(_EV, bn, body="SELECT can_id, count(*) AS frames FROM bn GROUP BY can_id")
    q["unknown_module_report"] = _with(_EV, bn, """sv AS (SELECT can_id, svc, count(*) AS n FROM bn GROUP BY ALL),
ids AS (SELECT can_id, count(*) AS n, min(ts_us) AS lo, max(ts_us) AS hi FROM bn GROUP BY can_id)""", body=f"""
SELECT can_id, CASE WHEN can_id = 582 THEN 'edr' END AS registry_key, CASE WHEN can_id = 582 THEN 'observed' ELSE 'unregistered' END AS registry_status, n AS observation_count, lo / 1e6 AS first_ts, hi / 1e6 AS last_ts,
  (hi - lo) / 1e6 AS duration_s, (SELECT string_agg(svc || '=' || n, ';' ORDER BY svc) FROM sv WHERE sv.can_id = ids.can_id) AS services,
  (SELECT count(*) FROM ev WHERE event_type = 'purchase' AND ts_us BETWEEN lo - {HOUR} AND hi + {HOUR}) AS nearby_markers, can_id + 1024 AS candidate_response_can_id,
  'hypothesisOnly' AS candidate_confidence, false AS transmit_authorized FROM ids""")
    q["recent_frames"] = _with(*fr, body="SELECT event_id AS sequence, ts_us, hx AS payload FROM fr ORDER BY ts_us DESC, event_id DESC LIMIT 500")
    q["recent_events"] = _with(*dm, body="SELECT event_id AS pos, ts_us, service FROM dm ORDER BY ts_us DESC, event_id DESC LIMIT 30")
    lo = 1_704_067_200_000_000 + 5 * DAY
    q["time_range"] = _with(*fr, body=f"SELECT event_id AS sequence, hx AS payload FROM fr WHERE ts_us >= {lo} AND ts_us < {lo + 7 * DAY}")
    q["frame_rate_1s"] = _with(_EV, """wf AS (SELECT iface, user_id, event_id, ts_us, unnest(range(0, CAST(CASE WHEN k + 1 <= 7 THEN 1 ELSE 1 + ceil((k + 1 - 6) / 7.0) + CASE cents % 7 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END END AS BIGINT))) AS i FROM ev)""",
        body="SELECT ((ts_us + i) // 1000000) * 1000000 AS second_us, iface, count(*) AS frames, count(DISTINCT user_id) AS ids FROM wf GROUP BY ALL")
    q["stream_capture"] = q["frames_bridge"]
    q["stream_distinct_ids"] = _with(*fr, body="SELECT DISTINCT 'events' AS session_id, iface, arb_id FROM fr")
    q["stream_isotp"] = q["isotp_reassembly"]
    q["stream_diag_pairs"] = q["live_pairs"]
    q["stream_bit_discovery"] = q["bit_event_candidates"]
    q["stream_validation"] = q["live_validation_steps"]
    q["stream_cells"] = _with(_EV, _VF, _BF, f"""sl AS (
  SELECT *, CASE WHEN bid - 1120 >= 16 THEN (bid - 1136) * 2 + 1 ELSE (bid - 1120) * 2 END AS slot, (ts_us - lo) // ((hi - lo) // 2 + 1) AS part
  FROM bf, (SELECT min(ts_us) AS lo, max(ts_us) AS hi FROM bf) WHERE bid < 1280),
lat AS (
  SELECT p.part AS upto, slot, arg_max([{', '.join(f'((c{2 * i} & 15) * 256 + c{2 * i + 1}) * CAST(0.00125 AS DOUBLE)' for i in range(3))}], struct_pack(t := ts_us, e := event_id)) AS v
  FROM sl JOIN (SELECT DISTINCT part FROM sl) p ON sl.part <= p.part GROUP BY ALL),
al AS (SELECT upto, list_reverse(flatten(list(v ORDER BY slot))) AS l FROM lat GROUP BY upto)""",
        body="SELECT 'all' AS session_id, (SELECT max(ts_us) FROM sl WHERE part = upto) AS ts_us, cell, l[cell + 1] AS volts FROM al, range(0, 96) t(cell) WHERE len(l) = 96")
    q["ingest_files"] = _with(*fr, body="SELECT iface AS session_id, ts_us, iface, arb_id, dlc, hx AS payload FROM fr")
    q["file_statuses"] = _with(_EV, body="""SELECT DISTINCT iface AS session_id, CASE iface WHEN 'can1' THEN 'hashMismatch' WHEN 'can2' THEN 'sizeMismatch' WHEN 'can3' THEN 'missing'
  WHEN 'can4' THEN 'unhashed' ELSE 'verified' END AS status FROM ev""")
    q["transcript_files"] = _with(_EV, body="""SELECT idx, count(*) AS rows, CAST(sum(CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS blank, min(ts_us) / 1e6 AS first_s, max(ts_us) / 1e6 AS last_s
FROM (SELECT *, row_number() OVER (PARTITION BY iface ORDER BY ts_us) AS idx FROM ev WHERE event_type = 'error') GROUP BY idx""")
    q["transcript_faults"] = _with(_EV, """t AS (SELECT iface, event_id AS idx, ts_us / 1e6 AS start_s, ts_us / 1e6 + (k - 10) * CAST(60 AS DOUBLE) AS end_s FROM ev WHERE event_type = 'purchase'),
l AS (SELECT *, lag(end_s) OVER (PARTITION BY iface ORDER BY idx) AS before FROM t)""", body="""SELECT iface, idx, CASE WHEN end_s < start_s THEN 'negativeDuration' ELSE 'overlap' END AS rule
FROM l WHERE end_s < start_s OR start_s < before""")
    q["registry_files"] = """SELECT 'S_' || p_partkey AS signal, p_partkey % 2048 AS can_id, p_brand AS message, p_partkey % 64 AS start_bit, p_size AS length,
  CASE WHEN p_partkey % 2 = 0 THEN 'intel' ELSE 'motorola' END AS endian, p_partkey % 2 = 0 AS signed, 0.5 AS scale, p_partkey % 7 AS "offset", p_name AS unit, p_type AS notes
FROM part WHERE p_partkey % 3 != 0 AND p_partkey % 5 != 0"""
    q["trace_files"] = f"SELECT trace_id, rule, detail, count(*) AS n FROM ({q['trace_validation']}) GROUP BY ALL"
    q["bench_files"] = _with(_EV, body="""SELECT CASE WHEN event_type = 'purchase' THEN 'marker' ELSE 'rx' END AS direction, CASE WHEN event_type = 'purchase' THEN 'step' ELSE '' END AS label, count(*) AS n,
  bit_xor(ts_us) AS times, count(DISTINCT CASE WHEN event_type != 'purchase' THEN user_id % 40 END) AS ids FROM ev GROUP BY ALL""")
    q["c5_table_files"] = _with(_EV, body="""SELECT user_id % 5 + 1 AS bus, user_id + 256 AS can_id, count(*) AS frames, count(*) AS rows, max(printf('%02X%04X0000000000', k, cents)) AS last_data
FROM ev WHERE event_type != 'view' AND user_id + 256 <= 2047 GROUP BY ALL""")
    q["bad_capture_lines"] = _with(_EV, body="""SELECT CASE k % 10 WHEN 1 THEN 'oddLengthData' WHEN 2 THEN 'malformed' ELSE 'read' END AS reason, count(*) AS lines FROM ev GROUP BY ALL""")
    q["session_overwrite"] = _with(*fr, body="SELECT iface AS session_id, arb_id, CAST(sum(CASE WHEN iface = 'can1' THEN -1 ELSE 1 END) AS BIGINT) AS frames FROM fr WHERE iface != 'can2' GROUP BY ALL")
    q["session_versions"] = _with(*fr, body="SELECT iface AS session_id, event_id AS sequence, ts_us, arb_id, hx AS payload FROM fr WHERE iface != 'can3' AND (iface != 'can1' OR event_id % 2 = 0)")
    q["endpoint_counters"] = _with(*dm, body="""SELECT 'endpoint' AS role, count(*) AS frames FROM dm WHERE can_id IN (2016, 2024, 2017, 2026) UNION ALL SELECT 'stream', count(*) FROM dm WHERE can_id = 2025""")

    line = "'(' || (ts_us // 1000000) || '.' || lpad(CAST(ts_us % 1000000 AS VARCHAR), 6, '0') || ') ' || iface || ' ' || printf('%03X', arb_id) || '#' || hx"
    q["candump_text"] = _with(*fr, body=f"SELECT event_id AS sequence, {line} AS value FROM fr")
    q["candump_parse"] = _with(*fr, body="SELECT event_id AS sequence, ts_us, iface, arb_id, length(printf('%03X', arb_id)) > 3 AS is_extended, dlc, hx AS payload FROM fr")
    q["candump_lenient"] = _with(*fr, body="""SELECT event_id AS sequence, ts_us, iface, arb_id, k = 3 AS remote, CASE WHEN k = 3 THEN 0 ELSE dlc END AS dlc, CASE WHEN k = 3 THEN '' ELSE hx END AS payload FROM fr WHERE k NOT IN (1, 2)""")
    q["marker_lines"] = _with(_EV, body="SELECT event_id AS sequence, ts_us, 'op' || (k % 3) AS source, 'step ' || k AS label FROM ev WHERE event_type = 'signup'")
    q["adapter_slcan"] = _with(*fr, body="SELECT event_id AS sequence, ts_us, arb_id, dlc = 3 AS is_extended, dlc, hx AS payload FROM fr")
    q["adapter_stm"] = _with(*fr, body="SELECT event_id AS sequence, ts_us, arb_id, dlc = 3 AS is_extended, dlc, hx AS payload FROM fr WHERE dlc = 3 OR code != 3")
    q["c5_load"] = _with(_EV, body="""SELECT 'trip/' || (event_id // 1000) || '.BIN' AS path, CASE WHEN event_type = 'view' THEN 'gps' ELSE 'can' END AS kind, (event_id % 1000) * 18 AS "offset", ts_us // 1000 - 1704067200000 AS timestamp_ms,
  CASE WHEN event_type != 'view' THEN user_id % 5 + 1 END AS bus, CASE WHEN event_type != 'view' THEN user_id + 256 END AS can_id, CASE WHEN event_type != 'view' THEN 8 END AS dlc,
  CASE WHEN event_type != 'view' THEN printf('%02X%04X', k, cents) || '0000000000' END AS payload, CASE WHEN event_type = 'view' THEN CAST(cents AS DOUBLE) END AS speed
FROM ev WHERE event_type = 'view' OR user_id + 256 <= 2047""")
    q["c5_summary"] = _with(_EV, body="""SELECT 'trip/' || (event_id // 1000) || '.BIN' AS path, count(*) FILTER (event_type != 'view' AND user_id + 256 <= 2047) AS can_records, count(*) FILTER (event_type = 'view') AS gps_records, 0 AS configured_ids,
  false AS malformed_tail, count(*) * 18 AS bytes_consumed FROM ev GROUP BY 1""")
    q["logger_anchor"] = _with(_EV, """ca AS (SELECT event_id // 1000 AS f, (event_id % 1000) * 18 AS o, ts_us // 1000 - 1704067200000 AS ms FROM ev WHERE event_type != 'view' AND user_id + 256 <= 2047),
an AS (SELECT f, min(ms) AS m0, 1000000000000000 + min(o) AS w0 FROM ca GROUP BY f)""", body="SELECT 'trip/' || f || '.BIN' AS path, o AS \"offset\", w0 + (ms - m0) * 1000 AS ts_us FROM ca JOIN an USING (f)")

    pt = _definitions()
    cols = """path, message, note, 8 AS dlc, raw_id AS arbitration_id, is_extended, {name} AS name, {sb} AS start_bit, {ln} AS length, {bo} AS byte_order, {sg} AS is_signed, CAST({f} AS DOUBLE) AS factor, CAST({o} AS DOUBLE) AS "offset",
  CAST({mx} AS DOUBLE) AS maximum, {u} AS unit, {rc} AS receivers, {mu} AS multiplex, {ch} AS choices"""
    size = cols.format(name="'Size_' || p_partkey", sb=7, ln=12, bo=0, sg="false", f="0.125", o="-40", mx="p_size", u="'mm'", rc="'NodeA,NodeB'", mu="NULL", ch="0")
    price = cols.format(name="'Price'", sb=16, ln=16, bo=1, sg="true", f="round(p_retailprice * 100) / CAST(1000 AS DOUBLE)", o="0", mx="1", u="''", rc="'Vector__XXX'", mu="'m1'", ch="2")
    q["dbc_load"] = _with(pt, body=f"SELECT {size} FROM pt UNION ALL SELECT {price} FROM pt")
    fault = lambda size, rule: f"SELECT path, '{rule}' AS rule, count(*) AS n FROM pt WHERE p_size = {size} GROUP BY path"
    q["dbc_violations"] = _with(pt, body=" UNION ALL ".join([fault(13, "dlcOutOfRange"), fault(17, "signalOutsideMessage"), fault(19, "malformedStatement")]))
    q["dbc_round_trip"] = """SELECT 'source' AS kind, count(DISTINCT p_partkey // 100) AS items, 0 AS differences FROM part UNION ALL SELECT 'node', count(DISTINCT p_partkey // 100) * 3, 0 FROM part
UNION ALL SELECT 'message', count(*), 0 FROM part UNION ALL SELECT 'signal', count(*) * 2, 0 FROM part UNION ALL SELECT 'value', count(*) * 2, 0 FROM part"""
    q["sim_reference_map"] = _with(*dm, _TRANSCRIPT, body=f"""SELECT module, {_sets('request_can_ids', "direction = 'request'")}, {_sets('normal_response_can_ids', "direction != 'request'")}, '' AS data_can_ids, '' AS functional_request_can_ids,
  (SELECT string_agg(service_id, ',' ORDER BY service_id) FROM (SELECT DISTINCT service_id FROM cl c WHERE c.module = m.module)) AS services,
  (SELECT string_agg(section, ',' ORDER BY section) FROM (SELECT DISTINCT section FROM cl c WHERE c.module = m.module)) AS sections FROM (SELECT DISTINCT module FROM cl WHERE module IS NOT NULL) m""")
    q["sim_services"] = _with(*dm, _TRANSCRIPT, body="SELECT service_id || ' ' || service AS service, count(*) AS rows FROM cl GROUP BY 1")
    arb = "CASE WHEN k % 3 = 0 THEN cents & 536870911 ELSE cents END"
    ext = "(k % 3 = 0 OR cents > 2047)"
    q["scalar_functions"] = _with(_EV, body=f"""SELECT event_id, {arb} AS arbitration_id, {ext} AS is_extended, ({arb}) + CASE WHEN {ext} THEN 2147483648 ELSE 0 END AS raw_id,
  CASE WHEN cents > 2047 THEN printf('%08X', cents) ELSE printf('%03X', cents) END AS id_text, printf('0x%02X', k) AS service_id, CASE WHEN 496 + user_id BETWEEN 512 AND 767 THEN 496 + user_id + 1024 END AS response_id,
  event_type || '\\\\' || '\\"' AS escaped, event_type || '\\"' AS plain, event_type || '__x' AS source, CASE WHEN k - 50 > 0 THEN value / CAST(k - 50 AS DOUBLE) ELSE 0 END AS ratio FROM ev""")
    return q


ORACLES = build()
