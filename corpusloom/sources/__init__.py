"""Files: gold questions, answers, entries, indexes, runs, cached replies, uploads, paths."""
