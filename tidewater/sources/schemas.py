"""Fixed schemas; production reads never infer."""

CONVERSATION = "struct<question string, answer string, start_time double, end_time double, task string, choices array<string>, temporal_windows array<array<double>>, frames_required string, temporal_clue_type string>"
VIDEO_SAMPLE = f"video_id string, video_path string, duration double, conversations array<{CONVERSATION}>"
RESULT = "video_id string, question string, answer string, pred_answer string, choices array<string>, correct_choice string, pred_choice string, qa_acc double, task string, retrieve_size int, chunk_size int, retrieval_info string"
WORD = "struct<start double, end double, word string>"
CLIP = f"video string, content array<{WORD}>, previous string, title string, category string"
BLOCK = "key string, block_id int, ts double, avg_vec array<float>, token_vecs array<array<float>>"
