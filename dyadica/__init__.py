"""dyadica: paired-design text and outcome analytics as DataFrame -> DataFrame operators."""
