"""Declared schemas of the engine's tables; readers never infer."""

from __future__ import annotations

PROBLEM = "pid string, task string, prompt string, answer string, meta struct<nums:array<int>,target:int,type:string,level:string>"
ATTEMPT = (
    "task string, pid string, sample int, layer int, hook_layer int, feature int, role string, alpha double, strength double, scope string, "
    "correct boolean, parsed boolean, pred string, gold string, n_tokens int, truncated boolean, markers map<string,int>, trace string"
)
TRACE = "response string, correct boolean, problem_id string"
DOMAIN_TRACE = (
    "pid string, sample int, source string, subtask string, answer string, extracted string, correct boolean, truncated boolean, "
    "finish_reason string, response string"
)
TRACE_METRIC = "pid string, sample int, correct boolean, source string, words int, n_segments int, hse double, hse_norm double, mean_dist double, single_voice boolean"
FEATURE = "index int, description string, max_act double, frac_nonzero double, embedding array<float>"
EXPLANATION = "index int, description string, embedding array<float>"
CALIBRATION = "layer int, mixture string, hook_layer int, n_tokens bigint, max_act array<double>, frac_nonzero array<double>"
POOL = "pid string, source string, subtask string, task string, answer string, gradable boolean, options array<string>"
PAIRED = "pid string, source string, subtask string, task string, answer string, dialogue string, monologue string"
SFT = "pid string, source string, prompt string, response string"
PPO = (
    "data_source string, prompt array<struct<role:string,content:string>>, ability string, "
    "reward_model struct<style:string,ground_truth:map<string,string>>, extra_info struct<split:string,index:bigint,raw_label:int>"
)
METRIC_POINT = "step bigint, metrics map<string,double>"
EVAL = "step bigint, val_accuracy double, parse_rate double, mean_completion_tokens double, train_acc_reward double, train_fmt_reward double"
RUN_SUMMARY = "name string, embedder string, shuffle boolean, handling string, n bigint, metrics map<string,struct<correct_mean:double,incorrect_mean:double,difference:double,ci95_low:double,ci95_high:double,ci_excludes_zero:boolean>>"
CORRUPT = "_corrupt"
