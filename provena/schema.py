"""Flat schemas of the data model: the nested tree of results is held as keyed tables.

Unsigned 32-bit values are BIGINT in [0, 2**32). A null string means "not observed", an empty one "observed empty". Track position 0 is a real
track before the first one or an unassigned one; -1 sectors means that a stream is not a whole number of sectors.
"""

STREAMS = "stream_index INT, path STRING, n_samples BIGINT, duration_s INT, sectors INT"
SAMPLES = "stream_index INT, j BIGINT, s BIGINT"
MATCHES = "stream_index INT, fingerprint_id STRING, score FLOAT, recording_id STRING, release_group_id STRING, release_id STRING, medium_pos INT, track_pos INT"
CATALOG_TRACKS = "release_id STRING, medium_pos INT, track_pos INT, recording_id STRING, title STRING"
DISCS = "release_id STRING, medium_pos INT, disc_id STRING, leadout INT"
DISC_OFFSETS = "disc_id STRING, position INT, offset INT"
AR_VOTES = "path STRING, entry INT, id1 BIGINT, id2 BIGINT, cddb BIGINT, track_pos INT, confidence INT, crc BIGINT, offset_crc BIGINT"
EAC_VOTES = "path STRING, track_pos INT, kind STRING, ordinal INT, crc32 BIGINT, count BIGINT, date BIGINT"
REMAP = "disc_id STRING, path STRING"
TAG_FIELDS = ("album", "album_artist", "artist", "compilation", "composer", "date", "disc", "sort_album_artist", "sort_artist", "sort_composer", "title", "track")
TAGS = "stream_index INT, " + ", ".join(f"{t} STRING" for t in TAG_FIELDS) + ", unknown ARRAY<STRING>"
ARTIST_CREDITS = "owner_id STRING, ordinal INT, artist_id STRING, name STRING, sort_name STRING, credited_name STRING, joinphrase STRING"
WORK_RELATIONS = "recording_id STRING, work_id STRING, role STRING, artist_id STRING, name STRING, sort_name STRING, additional BOOLEAN, instrumental BOOLEAN, ordinal INT"
ARRIVALS = "service STRING, arrival DOUBLE, ordinal INT"

#: Fixed values of the audio format and of the services.
SAMPLES_PER_SECTOR, SECTORS_PER_SECOND, LEAD_IN = 588, 75, 150
SKIP_HEAD, SKIP_TAIL = 2940, 2940
CRC_EDGE, CRC_POLYNOMIAL = 5881, 0xEDB88320
MISSING_METADATA = 10_000
INTERVALS = {"rip_database": 1 / 2, "fingerprint": 1 / 3, "catalogue": 1.0}
PAGE_SIZE, RETRIES, RETRY_PAUSE_S = 25, 5, 5
EAC_MAGICS = (0x9F3C29AA, 0x6BA2EAC3, 0x1E4932FE)
U32 = 1 << 32
