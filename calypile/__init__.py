"""Base-modification analytics for long reads on Spark."""

from calypile.api import parse_bam, plot_browser, plot_enrichment, plot_enrichment_profile, qc_report

__all__ = ["parse_bam", "plot_browser", "plot_enrichment", "plot_enrichment_profile", "qc_report"]
