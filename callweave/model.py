"""Table schemas (Spark DDL) shared by readers, operators and tests."""

SEGMENTS = (
    "call_id string, seg_idx long, start_time_s double, end_time_s double, speaker string, text string"
)
WORDS = "call_id string, word_idx long, start double, end double, text string, probability double"
SIGNAL_BLOCKS = "call_id string, block_idx long, sr int, samples array<double>"
FRAMES = (
    "call_id string, seg_idx long, frame_idx long, start_s double, energy double, rms double, zcr double, "
    "pitch_hz double"
)
CHUNK_EMBEDDINGS = "call_id string, chunk_idx long, class_idx int, embedding array<double>"
ACTIVATIONS = "call_id string, chunk_idx long, frame_idx long, probs array<double>"
STAGE_EVENTS = (
    "filename string, stage_id string, status string, time_s double, error string, event_time timestamp"
)
STORED_WORDS = "array<struct<start:double,end:double,text:string,probability:double>>"
TRANSCRIPT_STORE = (
    f"content_sha1 string, lang string, config map<string,string>, created_at timestamp, words {STORED_WORDS}"
)
RESULTS = "filename string, version long, doc string"
ANNOTATIONS = (
    "dialogue_id string, utterance_id string, speaker string, start double, end double, text string, "
    "emotion_label array<string>, intensity map<string,double>, sentiment string, interaction_state string, "
    "conduct_risk array<string>, uncertainty string, annotator_id string"
)
