"""Operations of a training-data pipeline: classifiers, deduplication, layout, packing and encoding."""
