"""Tables of the engine as StructTypes."""

from pyspark.sql.types import StructType

ENTITY = StructType.fromDDL(
    "id bigint, infohash string, name string, filenum int, filesize bigint, downnum int, createtime timestamp_ntz, updatetime timestamp_ntz, hasfile boolean, isdanger boolean"
)
ENTITY_FILE = StructType.fromDDL("info_hash_id bigint, files string")
DIRTY = StructType.fromDDL("infohash_id bigint")
KEYWORD = StructType.fromDDL("word string, num int, isdanger boolean")
SEARCH_HISTORY = StructType.fromDDL("word string, num int, last_search_time timestamp_ntz")
VISIT_HISTORY = StructType.fromDDL("infohash_id bigint, user_id string, visit_time timestamp_ntz")
STATISTICS = StructType.fromDDL("datakey string, num bigint, updatetime timestamp_ntz")
HOME_WORD = StructType.fromDDL("word string, `order` smallint, `index` int, type string")
PACKET = StructType.fromDDL("data binary, ip bigint, port int, ts timestamp")
NODE = StructType.fromDDL("node_id binary, ip bigint, port int")
